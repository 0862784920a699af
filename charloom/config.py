"""Settings of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


TRUE = ("1", "true", "yes", "on")


def _env(name: str, default):
    raw = os.environ.get(f"CHARLOOM_{name.upper()}")
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in TRUE
    return type(default)(raw)


def load_env(path: str | Path = ".env") -> None:
    """Puts the NAME=value lines of a file into the environment; what is set there already stays. A missing file is none."""
    if not Path(path).is_file():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("'\""))


@dataclass(frozen=True)
class Config:
    """Fixed defaults of chunking, thresholds and limits; CHARLOOM_<NAME> in the environment, or in a file
    .env of the current folder, goes before them."""

    model: str = "fake"
    api_key: str = ""
    workdir: str = "./work"
    chunk_tokens: int = 1800
    chunk_overlap: int = 200
    intake_chunk_tokens: int = 1200
    intake_chunk_overlap: int = 120
    max_chunks: int = 0
    #: A rank file that every task can read; sizes of chunks are tokens by it, without one characters.
    token_ranks: str = ""
    #: Chunks in one call of the model; 0 calls it for each.
    extract_batch: int = 0
    salience_threshold: float = 0.35
    dedup_threshold: float = 0.95
    max_input_mb: float = 100.0
    max_skills: int = 6
    max_dialogues: int = 6
    top_k: int = 10
    profile_max_entries: int = 0
    auto_merge: bool = True
    offline: bool = True

    @classmethod
    def from_env(cls, **over) -> Config:
        load_env()
        base = {n: _env(n, f.default) for n, f in cls.__dataclass_fields__.items()}
        return cls(**base | over)

    def __post_init__(self):
        if not self.offline and self.model != "fake" and not self.api_key:
            raise ValueError("an API key is needed unless offline is set")

    def folder(self) -> Path:
        """The work folder, with its parts."""
        out = Path(self.workdir)
        for part in ("distillates", "skills"):
            (out / part).mkdir(parents=True, exist_ok=True)
        return out
