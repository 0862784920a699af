"""Characters made up from a setting: four texts, then an interview, one turn after the other."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from charloom.sources import artifacts

from . import prompts
from .client import ModelClient, flatten


@dataclass(frozen=True)
class Setting:
    """Age is a text on purpose."""

    name: str
    age: str = ""
    background: str = ""
    traits: str = ""
    worldview: str = ""
    catchphrase: str = ""

    def text(self) -> str:
        labels = {"name": "姓名", "age": "年龄", "background": "背景", "traits": "性格", "worldview": "世界观", "catchphrase": "口头禅"}
        return "\n".join(f"{labels[k]}：{v}" for k, v in asdict(self).items() if v)


def write_corpus(setting: Setting, workdir: str, persona_id: str, ask: ModelClient) -> dict:
    folder = Path(workdir) / persona_id
    texts = {name: flatten(ask(p.format(setting=setting.text()))) for name, p in prompts.OC.items()}
    return {"folder": str(folder), "chars": artifacts.write_skeleton(folder, texts)}


def interview(setting: Setting, rounds: int, workdir: str, persona_id: str, ask: ModelClient) -> dict:
    """Asks and answers `rounds` times, each with what was said before, and writes the transcript beside the texts."""
    folder = Path(workdir) / persona_id
    player = prompts.PLAYER.format(setting=setting.text(), skeleton=artifacts.read_skeleton(folder))
    said: list[tuple[str, str]] = []
    for _ in range(rounds):
        so_far = "\n".join(f"问：{q}\n答：{a}" for q, a in said)
        question = flatten(ask(f"{prompts.INTERVIEWER}\n\n{so_far}")).strip()
        said.append((question, flatten(ask(f"{player}\n\n{so_far}\n问：{question}")).strip()))
    lines = [f"# {setting.name} 访谈", ""]
    for i, (q, a) in enumerate(said, 1):
        lines += [f"## 第 {i} 轮", "", f"**问**：{q}", "", f"**答**：{a}", ""]
    path = folder / "interview.md"
    path.write_text("\n".join(lines), encoding="utf-8")
    return {"path": str(path), "rounds": len(said), "turns": said}
