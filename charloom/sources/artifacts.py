"""Results on disk: cards, skills, dialogues, distillates and reports, written and read.

Distillates can be many and are written by Spark; what is one per persona is small and written by the driver, each file
through a temporary name, so a broken run leaves no half file.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charloom.functions.text import ensure_unique
from charloom.operators.distill import SIGNALS

SCHEMA_VERSION = 1
DISTILLATE = f"schema_version int, source_file string, chunk_index int, char_start int, char_end int, signals {SIGNALS}, summary string"
CARD_FIELDS = {"schema_version", "persona_id", "system_prompt", "display_name", "error_reply", "tags", "traits_summary", "expression_dna", "mental_models", "decision_heuristics", "anti_patterns", "honest_boundaries"}
#: The boundaries that every skill states, and the words that show it does.
BOUNDARIES = (
    (("直觉",), "无法蒸馏直觉", "框架能提取，灵感不能。该 skill 只复现可表述的思考路径。"),
    (("快照", "公开"), "仅基于公开语料的快照", "不等于本人真实信念，且不随本人后续变化更新。"),
)


class SchemaVersionError(ValueError):
    pass


def _write(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(path.name + ".part")
    temporary.write_text(text, encoding="utf-8")
    os.replace(temporary, path)
    return path


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def check_card(card: dict) -> dict:
    """The card, if it has what it must and nothing unknown."""
    if unknown := set(card) - CARD_FIELDS:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if missing := [k for k in ("persona_id", "system_prompt") if not card.get(k)]:
        raise ValueError(f"missing fields: {missing}")
    return card


def card_json(result: dict) -> dict:
    card = {k: v for k, v in result["card"].items() if v is not None}
    names = result.get("skill_names") or [s["name"] for s in result.get("skills", [])]
    return card | {"tools": {"mode": "default_all"}, "skills": {"mode": "specified", "paths": [f"skills/{n}/" for n in names], "names": names}, "preset_dialogues": result.get("dialogues", []), "metadata": result.get("metadata", {})}


def card_markdown(card: dict) -> str:
    tags = ", ".join(card.get("tags") or []) or "（无）"
    head = [f"# 人格卡：{card.get('display_name') or card['persona_id']}", "", f"- **人格ID**: `{card['persona_id']}`", f"- **标签**: {tags}", f"- **自定义报错回复**: {card.get('error_reply', '')}"]
    body = ["", "## 系统提示词", "", "```", card["system_prompt"], "```"]
    return "\n".join(head + body + (["", "## 特质摘要", "", card["traits_summary"]] if card.get("traits_summary") else [])) + "\n"


def dna_markdown(dna: dict) -> str:
    parts = [("偏好词汇", ", ".join((dna.get("vocabulary") or [])[:12])), ("节奏", dna.get("rhythm")), ("修辞习惯", ", ".join(dna.get("rhetorical_tics") or [])), ("标志性比喻", ", ".join(dna.get("signature_metaphors") or []))]
    lines = [f"- **{k}**：{v}" for k, v in parts if v]
    if dna.get("opening_samples"):
        lines += ["- **开场白示范**：", *(f"  > {s}" for s in dna["opening_samples"])]
    return "\n".join(lines or ["- （待提炼）"])


def skill_markdown(name: str, persona_id: str, skill: dict) -> str:
    """Front matter with a description of up to 1024 characters, then a section per layer; two boundaries are always there."""
    out = ["---", f"name: {name}", f"description: {(skill.get('description') or '').strip()[:1024]}", f"license: {(skill.get('license') or 'MIT').strip()}", "---", "", f"# {persona_id.replace('-', ' ').title()}", "", "## When to Use", (skill.get("when_to_use") or "").strip() or "- 见 description。", "", "## 工作流", (skill.get("instructions") or "").strip() or "（待补充）", ""]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend([f"## {title}", *lines, ""])

    models = []
    for m in skill.get("mental_models") or []:
        v = m.get("verification") or {}
        models += [f"### {m['name']}", f"**原理**：{m['principle']}", *(f"- {e}" for e in v.get("cross_domain_evidence") or [])]
        models += [f"**{k}**：{t}" for k, t in (("生成力示例", v.get("generative_example")), ("排他性", v.get("exclusivity_note")), ("应用", m.get("application"))) if t]
    section("心智模型", models)
    section("决策启发式", [f"- **{h['rule']}** —— 触发：{h['trigger']}" + (f"\n  - 例：{h['example']}" if h.get("example") else "") for h in skill.get("decision_heuristics") or []])
    section("表达 DNA", [dna_markdown(skill.get("expression_dna") or {})])
    section("反模式", [f"- **{a['pattern']}** —— {a['reason']}" + (f"\n  - 证据：{a['evidence']}" if a.get("evidence") else "") for a in skill.get("anti_patterns") or []])
    bounds = [(b["limitation"], b["reason"]) for b in skill.get("honest_boundaries") or []]
    for words, limitation, reason in BOUNDARIES:
        if not any(w in b for b, _ in bounds for w in words):
            bounds.append((limitation, reason))
    section("诚实边界", [f"- **{a}** —— {b}" for a, b in bounds])
    return "\n".join(out)


METHOD = """---
name: distillation-method
description: How to turn a corpus into a persona card. Use it before extracting, condensing or verifying persona signals.
---

# From corpus to persona card

1. Extract from one chunk at a time. Each signal has a category, its content, a verbatim piece of evidence and a salience from 0 to 1.
2. Condense over all chunks: merge signals that say the same, lift those that several sources support, drop the faint ones.
3. Verify each mental model: it shows in more than one domain, it predicts answers the corpus doesn't hold, and it sets the person apart.
4. Write the card: expression, models, decision rules, anti-patterns, and the limits of what the corpus can tell.
5. Design skills only around models that were verified.
"""


def skill_names(persona_id: str, names: list[str]) -> list[str]:
    """Folder names: cleaned, led by the persona's id, of 64 characters at most, each its own."""
    import re

    def clean(name: str, fallback: str) -> str:
        n = re.sub("-+", "-", re.sub("[^a-z0-9-]+", "-", name.strip().lower())).strip("-")
        return n if re.fullmatch("[a-z0-9][a-z0-9-]{0,63}", n) else fallback

    own, out = clean(persona_id, "persona"), []
    for i, name in enumerate(names):
        n = clean(name, f"{own}-skill-{i}")
        n = n if n.startswith(own) else f"{own}-{n}"[:64]
        out.append(ensure_unique(n, out))
    return out


def write_skills(folder: str | Path, persona_id: str, skills: list[dict]) -> list[Path]:
    names = skill_names(persona_id, [s["name"] for s in skills])
    return [_write(Path(folder) / "skills" / n / "SKILL.md", skill_markdown(n, persona_id, s)) for n, s in zip(names, skills)]


def write_method(folder: str | Path) -> Path:
    """The method itself as a skill that agents can load; returns the folder of skills."""
    _write(Path(folder) / "distillation-method" / "SKILL.md", METHOD)
    return Path(folder)


def write_distillates(distillates: DataFrame, path: str) -> None:
    """JSON lines, by Spark."""
    distillates.select(*(f.split()[0] for f in DISTILLATE.replace("array<struct<category:string,content:string,evidence:string,salience:double>>", "x").split(", "))).write.mode("overwrite").json(path)


def read_distillates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DISTILLATE).json(path)


def distillate_name(source, chunk_index):
    """The file name of one distillate: signs other than letters, digits, - and _ as _, and the index in four digits."""
    return F.concat(F.regexp_replace(source, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"), F.lpad(chunk_index.cast("string"), 4, "0"), F.lit(".json"))


def save_result(folder: str | Path, result: dict, distillates: DataFrame | None = None) -> Path:
    """Card, skills, dialogues and the whole result without distillates, which go to their own file; a report, if there is one."""
    out = Path(folder)
    result = result | {"skill_names": skill_names(result["card"]["persona_id"], [s["name"] for s in result.get("skills", [])])}
    _write(out / "persona_card.json", _dump(card_json(result)))
    _write(out / "persona_card.md", card_markdown(result["card"]))
    write_skills(out, result["card"]["persona_id"], result.get("skills", []))
    _write(out / "preset_dialogues.json", _dump(result.get("dialogues", [])))
    _write(out / "distillation_result.json", _dump({"schema_version": SCHEMA_VERSION, **{k: v for k, v in result.items() if k != "skill_names"}}))
    if report := result.get("metadata", {}).get("eval_report"):
        _write(out / "eval_report.json", _dump(report))
    if distillates is not None:
        write_distillates(distillates, f"file://{out.resolve()}/distillates.jsonl")
    return out


def load_result(path: str | Path) -> dict:
    """A saved result, or a bare card in its place; other versions are refused, a missing one counts as the first."""
    p = Path(path)
    p = p / "distillation_result.json" if p.is_dir() else p
    data = json.loads(p.read_text(encoding="utf-8"))
    if (version := data.get("schema_version", 1)) != SCHEMA_VERSION:
        raise SchemaVersionError(f"{p} has version {version}; this reads {SCHEMA_VERSION}")
    if "card" not in data:
        data = {"schema_version": 1, "card": check_card(data), "skills": [], "dialogues": [], "metadata": {}}
    check_card(data["card"])
    return data


def load_report(path: str | Path) -> dict:
    p = Path(path)
    p = p / "eval_report.json" if p.is_dir() else p
    if not p.exists():
        raise FileNotFoundError(p)
    try:
        data = json.loads(p.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ValueError(f"{p} is not JSON: {e}") from e
    if data.get("schema_version", 1) != SCHEMA_VERSION:
        raise SchemaVersionError(f"{p} has version {data['schema_version']}")
    if "overall_score" not in data:
        raise ValueError(f"{p} is no report")
    return data


def personas(folder: str | Path) -> list[str]:
    """Folders below that hold a card, sorted."""
    return sorted(str(p.parent) for p in Path(folder).glob("*/persona_card.json"))


def write_corpus(folder: str | Path, row, relations: list[dict]) -> list[Path]:
    """The rebuilt corpus of one character, from a row of profile.rebuilt()."""
    out = [_write(Path(folder) / name, getattr(row, column)) for name, column in (("speech.md", "speech_md"), ("appearance.md", "appearance_md"), ("events.md", "events_md"), ("summary.md", "summary_md"))]
    return [*out, _write(Path(folder) / "relationships.json", _dump({"target": row.character_name, "relations": relations}))]


#: The files of a written character.
SKELETON = ("monologue.md", "dialogue.md", "event.md", "memory.md")


def read_skeleton(folder: str | Path) -> str:
    found = [p.read_text(encoding="utf-8") for n in SKELETON if (p := Path(folder) / n).exists()]
    if not found:
        raise FileNotFoundError(f"no skeleton under {folder}")
    return "\n\n---\n\n".join(found)


def write_skeleton(folder: str | Path, texts: dict[str, str]) -> dict[str, int]:
    """Writes the four files and returns their lengths."""
    for name in SKELETON:
        _write(Path(folder) / name, texts[name])
    return {name: len(texts[name]) for name in SKELETON}
