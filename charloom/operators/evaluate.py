"""Scores of persona cards: coverage by arithmetic, fidelity and identifiability by a model, and the report."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charloom.functions import text as T

#: Weights and the counts that earn them in full.
RICHNESS = {"vocab_n": (0.30, 15), "rhythm_present": (0.15, 1), "tics_n": (0.20, 5), "metaphors_n": (0.20, 3), "openings_n": (0.15, 2)}
EXPRESSION, MODELS, PATTERNS, BOUNDARIES, HEURISTICS = 0.25, (0.30, 5), (0.20, 3), (0.10, 2), (0.15, 3)
COVERAGE, FIDELITY, IDENTIFIABILITY = 0.3, 0.4, 0.3
COUNTS = ("vocab_n", "rhythm_present", "tics_n", "metaphors_n", "openings_n", "mm_n", "mm_passed", "ap_n", "hb_n", "dh_n")


def cap_ratio(count: Column, cap: int) -> Column:
    return F.least(count / F.lit(float(cap)), F.lit(1.0)) if cap > 0 else F.lit(0.0)


def counts(cards: DataFrame) -> DataFrame:
    """The counts that coverage needs, from the nested fields of cards."""
    e = F.col("expression_dna")
    ok = lambda m: m["verification"]["cross_domain"] & m["verification"]["generative"] & m["verification"]["exclusive"]
    return cards.select(
        "persona_id", F.size(e["vocabulary"]).alias("vocab_n"), (e["rhythm"] != "").cast("int").alias("rhythm_present"), F.size(e["rhetorical_tics"]).alias("tics_n"), F.size(e["signature_metaphors"]).alias("metaphors_n"), F.size(e["opening_samples"]).alias("openings_n"),
        F.size("mental_models").alias("mm_n"), F.size(F.filter("mental_models", ok)).alias("mm_passed"), F.size("anti_patterns").alias("ap_n"), F.size("honest_boundaries").alias("hb_n"), F.size("decision_heuristics").alias("dh_n"),
    )


def coverage(cards: DataFrame) -> DataFrame:
    """Adds richness, pass_rate, total_score and whether all fields are empty, to rows with the counts."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rich = clamp(sum((cap_ratio(F.col(c), cap) * w for c, (w, cap) in RICHNESS.items()), F.lit(0.0)))
    rate = F.when(F.col("mm_n") > 0, F.col("mm_passed") / F.col("mm_n").cast("double")).otherwise(F.lit(0.0))
    term = lambda c, w: cap_ratio(F.col(c), w[1]) * w[0]
    out = cards.withColumn("richness", rich).withColumn("pass_rate", rate)
    total = F.col("richness") * EXPRESSION + cap_ratio(F.col("mm_n"), MODELS[1]) * F.col("pass_rate") * MODELS[0] + term("ap_n", PATTERNS) + term("hb_n", BOUNDARIES) + term("dh_n", HEURISTICS)
    empty = sum((F.col(c) for c in COUNTS if c != "mm_passed"), F.lit(0)) == 0
    return out.withColumn("total_score", clamp(total)).withColumn("all_empty", empty)


def overall(total: Column, fidelity: Column, confidence: Column, correct: Column) -> Column:
    """Coverage alone where nothing was judged; else weighted, a failed judgement (-1) counting 0 and a wrong guess half."""
    ident = F.when(confidence < 0, 0.0).when(correct, 1.0).otherwise(confidence * 0.5)
    online = total * COVERAGE + F.greatest(fidelity, F.lit(0.0)) * FIDELITY + ident * IDENTIFIABILITY
    return F.when(fidelity.isNull() & confidence.isNull(), total).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), online)))


def corpus_digest(distillates: DataFrame, keys: list[str]) -> DataFrame:
    """A readable summary of the distillates, per keys: in order of `ord`, a heading, the summary and a line per signal."""
    rows = distillates.select("*", F.row_number().over(_by(keys)).alias("_n"))
    line = lambda s: F.concat(F.lit("- ["), s["category"], F.lit("] "), s["content"], F.when(s["evidence"] != "", F.concat(F.lit("｜证据: "), s["evidence"])).otherwise(F.lit("")))
    head = F.concat(F.lit("### 分块 "), F.col("_n").cast("string"), F.lit("（来源: "), "source_file", F.lit(", chunk="), F.col("chunk_index").cast("string"), F.lit("）"))
    summary = F.when(F.col("summary") != "", F.array(F.concat(F.lit("摘要: "), "summary"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_l", F.array_join(F.concat(F.array(head), summary, F.transform("signals", line)), "\n"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n").alias("digest"))


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("ord")


def _json(text: str) -> dict:
    m = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    body = m[1] if m else text
    a, b = body.find("{"), body.rfind("}")
    if not 0 <= a < b:
        raise ValueError("no JSON object in the reply")
    return json.loads(body[a : b + 1])


def fidelity(ask: Callable[[str], str], card: str, corpus: str) -> dict:
    """A judge's score within 0 and 1 and its reasons; -1 where the call or its reply fails."""
    try:
        reply = _json(ask(f"比较语料与人格卡，给出 JSON：score（0 到 1）与 reasons。\n\n{corpus}\n\n{card}"))
        return {"score": max(0.0, min(1.0, float(reply["score"]))), "reasons": [str(r) for r in reply.get("reasons", [])]}
    except Exception as e:
        return {"score": -1.0, "reasons": [f"{type(e).__name__}: {e}"]}


def split_probe(text: str) -> list[str]:
    """Plain form of functions.text.split_probe for a single reply."""
    marks = [m.start() for m in re.finditer(r"q:", text, re.IGNORECASE)]
    if len(marks) < 2:
        return [text.strip()] if text else []
    return [text[a:b].strip() for a, b in zip(marks, [*marks[1:], len(text)])]


def identifiability(ask: Callable[[str], str], persona_id: str, display_name: str, card: str, corpus: str, probes: int = 5) -> dict:
    """Whether a blind guess from answers in the persona's voice names it; confidence -1 where a call fails."""
    n = max(1, min(5, probes))
    out = {"probes": [], "correct": False, "confidence": -1.0, "guessed": ""}
    try:
        out["probes"] = split_probe(ask(f"以此人格回答 {n} 个问题，每个以 Q: 开头。\n\n{card}"))
        reply = _json(ask("根据以下回答猜测人物，给出 JSON：name 与 confidence。\n\n{}\n\n{}".format("\n".join(out["probes"]), corpus)))
        guess = str(reply.get("name", "")).strip()
        names = [x.lower() for x in (display_name, persona_id) if x]
        out["guessed"], out["correct"] = guess, bool(guess) and any(guess.lower() in x or x in guess.lower() for x in names)
        out["confidence"] = max(0.0, min(1.0, float(reply["confidence"])))
    except Exception as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def report(total: float, judged: dict | None = None, guessed: dict | None = None) -> dict:
    """The report of one card; without judgements, coverage alone."""
    score = total
    if judged is not None and guessed is not None:
        ident = 0.0 if guessed["confidence"] < 0 else 1.0 if guessed["correct"] else guessed["confidence"] * 0.5
        score = max(0.0, min(1.0, total * COVERAGE + max(judged["score"], 0.0) * FIDELITY + ident * IDENTIFIABILITY))
    return {"schema_version": 1, "coverage": total, "fidelity": judged, "identifiability": guessed, "overall_score": score, "created_at": datetime.now(timezone.utc).isoformat()}


def report_markdown(r: dict) -> str:
    lines = ["# 评估报告", "", f"- **总分**: {r['overall_score']:.4f}", f"- **覆盖度**: {r['coverage']:.4f}"]
    for name, key, value in (("保真度", "fidelity", "score"), ("可识别度", "identifiability", "confidence")):
        lines.append(f"- **{name}**: " + ("未评估" if r[key] is None else "失败" if r[key][value] < 0 else f"{r[key][value]:.4f}"))
    return "\n".join([*lines, f"- **时间**: {r['created_at']}", ""])


def card_digest(card: dict) -> str:
    """A card as a judge reads it: its prompt, then a section per layer."""
    e = card.get("expression_dna") or {}
    out = [f"### PersonaCard (persona_id={card['persona_id']})", "## system_prompt", card.get("system_prompt") or "(空)", "## expression_dna"]
    out += [f"- {k}: {e.get(k) or ('(空)' if k == 'rhythm' else [])}" for k in ("vocabulary", "rhythm", "rhetorical_tics", "signature_metaphors", "opening_samples")]
    out.append("## mental_models")
    for m in card.get("mental_models") or []:
        v = m.get("verification") or {}
        out.append(f"- {m['name']}：{m['principle']}（" + ", ".join(f"{k}={bool(v.get(k))}" for k in ("cross_domain", "generative", "exclusive")) + "）")
    for layer, a, label, b in (("decision_heuristics", "rule", "触发", "trigger"), ("anti_patterns", "pattern", "理由", "reason"), ("honest_boundaries", "limitation", "理由", "reason")):
        out += [f"## {layer}", *(f"- {x[a]}（{label}: {x[b]}）" for x in card.get(layer) or [])]
    return "\n".join(out)
