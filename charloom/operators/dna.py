"""Sectioned prompts to nested records.

Lines become rows, a heading opens a section for the lines after it, and each field is read from its sections' lines; all with
DataFrame functions, so millions of prompts parse in parallel. A prompt's lines meet in two aggregates, by section and by prompt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings and the forms they come in, tried in this order.
CN = ("身份", "性格", "说话风格", "知识边界", "情绪模式", "心智模型与认知", "心智模型", "雷区", "输出约束", "开场白示范", "表达DNA", "决策启发式", "反模式", "诚实边界")
CN_MORE = ("修辞", "口头禅", "高频词", "句式", "比喻偏好")
EN = (
    "Identity", "Background", "Character", r"Speech(?:\s+Style)?", r"Knowledge(?:\s+Boundary)?", r"Knowledge\s+Boundaries", r"Emotional\s+Pattern",
    r"Mental\s+Models?", r"Decision\s+Heuristics?", r"Anti[-\s]?Patterns?", r"Honest\s+Boundaries", r"Expression\s+DNA", "Rhetoric",
    r"Opening\s+Samples?", r"Output\s+Constraints?", r"Signature\s+Metaphors?", "Rhythm", "Vocabulary", "Taboos?", r"Red\s+Lines?",
)
_CN, _CN_ALL, _EN = "|".join(CN), "|".join(CN + CN_MORE), "|".join(EN)
HEADINGS = (
    rf"(?U)^\s*#{{1,6}}\s*({_CN_ALL})\s*$",
    rf"(?iU)^\s*#{{1,6}}\s*({_EN})\s*$",
    rf"(?iU)^\s*(?:#{{1,6}}\s*)?({_EN})\s*[:：]\s*$",
    rf"(?U)^\s*[【\[]\s*({_CN_ALL})\s*[】\]]\s*$",
    rf"(?U)^\s*[（(]\s*({_CN})\s*[)）]\s*$",
    rf"(?U)^\s*({_CN})\s*[:：]\s*$",
)
#: The field that a section's lines go to.
FIELDS = {
    "expression_dna": ("说话风格", "开场白示范", "表达dna", "speech", "speech style", "expression dna", "rhetoric", "rhythm", "vocabulary", "signature metaphors", "opening samples", "opening sample"),
    "mental_models": ("心智模型", "心智模型与认知", "mental models", "mental model"),
    "anti_patterns": ("雷区", "反模式", "anti-patterns", "anti-pattern", "anti patterns", "anti pattern", "taboos", "taboo", "red lines", "red line"),
    "decision_heuristics": ("决策启发式", "decision heuristics", "decision heuristic"),
    "honest_boundaries": ("诚实边界", "honest boundaries", "honest boundary"),
}
#: Line breaks, bullets, keyed bullets and default texts.
BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
BULLET = r"(?U)^\s*(?:[-*·]|\d+[.、．)])\s*"
EXPRESSION_KEYS = {
    "vocabulary": ("高频词", "词汇"),
    "rhetorical_tics": ("口头禅", "rhetorical tics", "修辞"),
    "signature_metaphors": ("比喻偏好", "标志性比喻", "比喻"),
    "rhythm": ("句式范例", "句式", "节奏"),
    "opening_samples": ("开场白示范", "开场白"),
}
EXPRESSION_LINE = r"(?iU)^\s*(?:[-*·]|\d+[.、．)])\s*(高频词|词汇|口头禅|句式范例|句式|节奏|修辞|比喻偏好|标志性比喻|比喻|开场白示范|开场白|thinking\s*style|rhetorical\s*tics)\s*[:：]\s*(.+?)\s*$"
CHECKS = {"cross": ("跨域", "跨域复现"), "generative": ("生成力", "有生成力"), "exclusive": ("排他性", "有排他性")}
ARROW = r"(?U)^\s*(?:[-*·]|\d+[.、．)])\s*(.+?)\s*(?:→|->|⇒|=>|：:)\s*(.+?)\s*$"
NO_REASON, ANY_TRIGGER, NO_BOUNDARY = "触发后该人格会硬而短地拒绝", "一般决策场景", "基于语料的边界声明"
QUOTING_SECTIONS = ("开场白示范", "opening samples", "opening sample", "说话风格", "speech style", "speech")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def heading(line: Column) -> Column:
    """The section that a line names, in small letters, or null."""
    return F.coalesce(*(F.when(line.rlike(p), F.lower(_strip(F.regexp_extract(line, p, 1)))) for p in HEADINGS))


def strip_bullet(line: Column) -> Column:
    return _strip(F.regexp_replace(line, BULLET, ""))


def list_items(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[、，,；;|｜\n]+"), _strip), lambda p: p != ""))


def field_of(section: Column) -> Column:
    out = F.lit(None).cast("string")
    for field, names in FIELDS.items():
        out = F.when(section.isin(*names), field).otherwise(out)
    return out


def sections(prompts: DataFrame, key: str, text: str = "system_prompt") -> DataFrame:
    """(key, section_no, section, line_no, line): non-blank lines without the headings; section '' comes before the first."""
    lines = prompts.select(key, F.posexplode(F.split(text, BREAKS)).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"(?U)\s+\z", "")).where("line != ''")
    so_far = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("_h", heading(F.col("line"))).withColumn("section_no", F.sum(F.col("_h").isNotNull().cast("int")).over(so_far)).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(so_far), F.lit("")))
    return lines.where("_h is null").select(key, "section_no", "section", "line_no", "line")


def _head_tail(line: Column) -> tuple[Column, Column, Column]:
    """(whether there is a colon, what is before and after the first one); a full-width one goes first."""
    wide, narrow = F.instr(line, "："), F.instr(line, ":")
    at = F.when(wide > 0, wide).otherwise(narrow)
    return at > 0, _strip(F.substr(line, F.lit(1), at - 1)), _strip(F.substr(line, at + 1))


def quotes(text: Column) -> Column:
    angled = F.regexp_extract_all(text, F.lit("「(.*?)」"), F.lit(1))
    return F.when(F.size(angled) > 0, angled).otherwise(F.regexp_extract_all(text, F.lit('"(.*?)"'), F.lit(1)))


def expression(lines: DataFrame, key: str) -> DataFrame:
    """expression_dna per key. Within a section the last line of a key counts; over sections lists append and the first rhythm stays."""
    raw, plain = F.col("line"), strip_bullet(F.col("line"))
    name = F.lower(_strip(F.regexp_extract(raw, EXPRESSION_LINE, 1)))
    own = lines.where("field = 'expression_dna'").withColumn("plain", plain).where("plain != ''").withColumn("k", F.when(raw.rlike(EXPRESSION_LINE), name)).withColumn("val", _strip(F.regexp_extract(raw, EXPRESSION_LINE, 2))).withColumn("q", quotes(F.col("plain")))
    last = lambda f: F.max_by(F.when(F.col("k").isin(*EXPRESSION_KEYS[f]), F.col("val")), F.when(F.col("k").isin(*EXPRESSION_KEYS[f]), F.col("line_no")))
    vq = quotes(F.col("val"))
    opened = F.when(F.col("k").isin(*EXPRESSION_KEYS["opening_samples"]), F.when(F.size(vq) > 0, vq).otherwise(F.array("val"))).when(F.col("k").isNull() & (F.size("q") > 0) & F.col("section").isin(*QUOTING_SECTIONS), F.col("q"))
    # a line without a bullet that gives frequent words is the way out where no keyed line does
    loose = F.regexp_extract("plain", r"(?U)高频词[:：]\s*(.+?)(?:[。；;]|$)", 1)
    by = own.withColumn("open", opened).withColumn("loose", F.nullif(loose, F.lit(""))).groupBy(key, "section_no").agg(
        last("vocabulary").alias("v"), last("rhetorical_tics").alias("t"), last("signature_metaphors").alias("m"), last("rhythm").alias("r"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("open").isNotNull(), F.struct("line_no", "open")))), lambda x: x["open"])).alias("o"), F.min_by("loose", F.when(F.col("loose").isNotNull(), F.col("line_no"))).alias("loose"),
    )
    items = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(list_items(c))
    by = by.select(key, F.struct("section_no", F.when(F.size(items(F.col("v"))) > 0, items(F.col("v"))).otherwise(items(F.col("loose"))).alias("v"), items(F.col("t")).alias("t"), items(F.col("m")).alias("m"), "o", "r").alias("s"))
    every = by.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    flat = lambda f: F.array_distinct(F.flatten(F.transform("s", lambda x: x[f])))
    rhythm = F.coalesce(F.get(F.filter(F.transform("s", lambda x: x["r"]), lambda r: F.coalesce(r != "", F.lit(False))), F.lit(0)), F.lit(""))
    return every.select(key, F.struct(flat("v").alias("vocabulary"), rhythm.alias("rhythm"), flat("t").alias("rhetorical_tics"), flat("m").alias("signature_metaphors"), flat("o").alias("opening_samples")).alias("expression_dna"))


def mental_models(lines: DataFrame, key: str) -> DataFrame:
    """mental_models per key: a line that isn't one of the three checks opens a model; the checks after it are its own."""
    own = lines.where("field = 'mental_models'").withColumn("plain", strip_bullet(F.col("line"))).where("plain != ''")
    colon, head, tail = _head_tail(F.col("plain"))
    kind = F.lit(None).cast("string")
    for k, names in CHECKS.items():
        kind = F.when(colon & head.isin(*names), k).otherwise(kind)
    in_section = Window.partitionBy(key, "section_no").orderBy("line_no")
    own = own.withColumn("kind", kind).withColumn("name", F.when(colon, head).otherwise(F.col("plain"))).withColumn("tail", F.when(colon, tail).otherwise(F.lit("")))
    own = own.withColumn("n", F.sum(F.col("kind").isNull().cast("int")).over(in_section))
    value = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("tail")), F.when(F.col("kind") == k, F.col("line_no")))
    has = lambda k: F.coalesce(F.max(F.col("kind") == k), F.lit(False))
    by = own.groupBy(key, "section_no", "n").agg(
        F.min_by("name", F.when(F.col("kind").isNull(), F.col("line_no"))).alias("name"), F.min_by("tail", F.when(F.col("kind").isNull(), F.col("line_no"))).alias("principle"),
        has("cross").alias("cross_domain"), F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "cross", F.struct("line_no", "tail")))), lambda x: x["tail"]), 1, 4).alias("cross_domain_evidence"),
        has("generative").alias("generative"), F.coalesce(value("generative"), F.lit("")).alias("generative_example"), has("exclusive").alias("exclusive"), F.coalesce(value("exclusive"), F.lit("")).alias("exclusivity_note"),
    ).where("n > 0 and name != ''")
    model = F.struct("name", "principle", F.struct("cross_domain", "generative", "exclusive", "cross_domain_evidence", "generative_example", "exclusivity_note").alias("verification"))
    return by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "n", model.alias("m")))), lambda x: x["m"]).alias("mental_models"))


def _pairs(lines: DataFrame, key: str, field: str, a: str, b: str, first: Column, second: Column) -> DataFrame:
    own = lines.where(F.col("field") == field).withColumn("plain", strip_bullet(F.col("line"))).where("plain != ''").withColumn("_p", F.struct(first.alias(a), second.alias(b)))
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_p"))), lambda x: x["_p"]).alias(field))


def extract(prompts: DataFrame, key: str, text: str = "system_prompt") -> DataFrame:
    """Per prompt its five fields; empty ones where the prompt has no such section."""
    lines = sections(prompts, key, text).withColumn("field", field_of(F.col("section"))).where("field is not null")
    colon, head, tail = _head_tail(F.col("plain"))
    arrow = F.col("line").rlike(ARROW)
    or_else = lambda c, d: F.when(c == "", F.lit(d)).otherwise(c)
    pattern = F.when(arrow, _strip(F.regexp_extract("line", ARROW, 1))).when(colon, head).otherwise(F.col("plain"))
    reason = or_else(F.when(arrow, _strip(F.regexp_extract("line", ARROW, 2))).when(colon, tail).otherwise(F.lit("")), NO_REASON)
    parts = [
        expression(lines, key),
        mental_models(lines, key),
        _pairs(lines, key, "anti_patterns", "pattern", "reason", pattern, reason),
        _pairs(lines, key, "decision_heuristics", "rule", "trigger", F.when(colon, head).otherwise(F.col("plain")), or_else(F.when(colon, tail).otherwise(F.lit("")), ANY_TRIGGER)),
        _pairs(lines, key, "honest_boundaries", "limitation", "reason", F.when(colon, head).otherwise(F.col("plain")), F.when(colon, tail).otherwise(F.lit(NO_BOUNDARY))),
    ]
    out = reduce(lambda x, y: x.join(y, key, "left"), parts, prompts.select(key).distinct())
    none = F.struct(F.array().cast("array<string>").alias("vocabulary"), F.lit("").alias("rhythm"), *(F.array().cast("array<string>").alias(f) for f in ("rhetorical_tics", "signature_metaphors", "opening_samples")))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(key, F.coalesce("expression_dna", none).alias("expression_dna"), *(empty(c) for c in ("mental_models", "anti_patterns", "decision_heuristics", "honest_boundaries")))


def backfill(cards: DataFrame, key: str = "persona_id", text: str = "system_prompt") -> DataFrame:
    """Fills only the fields a card leaves empty, from its own prompt; within expression_dna, part by part."""
    found = extract(cards, key, text)
    names = ("mental_models", "anti_patterns", "decision_heuristics", "honest_boundaries")
    joined = cards.join(found.select(key, F.col("expression_dna").alias("_e"), *(F.col(n).alias(f"_{n}") for n in names)), key, "left")
    for n in names:
        joined = joined.withColumn(n, F.when(F.size(n) > 0, F.col(n)).otherwise(F.col(f"_{n}").cast(cards.schema[n].dataType)))
    e = F.col("expression_dna")
    lists = [F.when(F.size(e[f]) > 0, e[f]).otherwise(F.col("_e")[f]).alias(f) for f in ("vocabulary", "rhetorical_tics", "signature_metaphors", "opening_samples")]
    rhythm = F.when(e["rhythm"] != "", e["rhythm"]).otherwise(F.col("_e")["rhythm"]).alias("rhythm")
    return joined.withColumn("expression_dna", F.struct(lists[0], rhythm, *lists[1:])).select(*cards.columns)
