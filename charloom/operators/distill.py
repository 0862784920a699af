"""Signals to a persona card: extraction, condensing rules, batches, verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from charloom.functions import text as T

from .patterns import occurring
from .tiles import numbered

#: Fixed values.
CATEGORIES = ("speech_style", "catchphrase", "values", "knowledge", "emotion", "relationships", "signature_event", "background", "taboo", "mannerism")
BATCH_OVER, BATCH_SIZE, MAX_FAILED = 30, 20, 0.5
ERROR_REPLY = "……抱歉，我走神了，能再说一遍吗？"
SIGNALS = "array<struct<category:string,content:string,evidence:string,salience:double>>"


class TooManyFailures(RuntimeError):
    pass


def extractor_prompt(source: Column, total: Column) -> Column:
    """The request for one chunk, from chunk_index, char_start, char_end, token_count and text."""
    return F.concat(
        F.lit("【来源】"), source, F.lit("（第 "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(" 块，字符 "), F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string"),
        F.lit("，约 "), F.col("token_count").cast("string"), F.lit(" tokens）\n\n【正文】\n"), F.col("text"), F.lit("\n\n请按类别提取人格信号，逐条给出 evidence 与 salience，并写出不超过 120 字的 summary。"),
    )


def extract_signals(chunks: DataFrame, ask: Callable[[str], dict], prompt: str = "prompt") -> DataFrame:
    """Calls the model for each chunk. A failure is a row with `error`, never a failed task; where a signal is from is taken
    from the chunk, whatever the reply says. Write the result before it is used twice: a task may be run again."""
    schema = StructType([*chunks.drop(prompt).schema.fields, *StructType.fromDDL(f"signals {SIGNALS}, summary string, error string").fields])
    fields, at = to_arrow_schema(schema), chunks.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals, summary, error = [], [], []
            for request in batch.column(at).to_pylist():
                try:
                    reply = ask(request)
                    signals.append(_signals(reply))
                    summary.append(reply.get("summary", ""))
                    error.append(None)
                except Exception as e:
                    signals.append(None)
                    summary.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(signals, type=fields.field("signals").type), pa.array(summary, pa.string()), pa.array(error, pa.string())], schema=fields)

    return chunks.mapInArrow(run, schema)


def _signals(found: dict) -> list[dict]:
    """A reply's signals in full; one out of range makes the reply a failure."""
    out = [{"category": s["category"], "content": s["content"], "evidence": s.get("evidence", ""), "salience": float(s.get("salience", 0.5))} for s in found.get("signals") or []]
    if any(s["category"] not in CATEGORIES or not 0 <= s["salience"] <= 1 for s in out):
        raise ValueError("a category or salience is out of range")
    return out


def extract_batches(chunks: DataFrame, ask: Callable[[str], dict], request: str, size: int = 8) -> DataFrame:
    """One call of the model for every `size` chunks of a source in order, as a JSON array; its reply has `items`, one for each
    chunk by source_file and chunk_index. The same rows as extract_signals(): a chunk that the reply leaves out, gives twice
    differently or gets wrong is a row with `error`, and so are all chunks of a call that fails; nothing else in a reply counts,
    positions least of all. chunks: source_file, chunk_index, char_start, char_end, token_count, text and more."""
    keys = ["source_file", "chunk_index"]
    place = Window.partitionBy("source_file").orderBy("chunk_index")
    rows = chunks.select(*keys, F.struct(F.col("source_file").alias("source"), "chunk_index", "char_start", "char_end", "token_count", "text").alias("c")).withColumn("_b", F.floor((F.row_number().over(place) - 1) / size))
    calls = rows.groupBy("source_file", "_b").agg(F.array_sort(F.collect_list(F.col("chunk_index").cast("int"))).alias("indexes"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "c"))), lambda x: x["c"])).alias("body"))
    schema = StructType.fromDDL(f"source_file string, chunk_index int, signals {SIGNALS}, summary string, error string")
    fields = to_arrow_schema(schema)

    def answer(source: str, indexes: list[int], body: str) -> list[dict]:
        try:
            reply = ask(f"{request}\n\n{body}")
            items = reply["items"]
        except Exception as e:
            return [{"source_file": source, "chunk_index": i, "error": f"{type(e).__name__}: {e}"} for i in indexes]
        by: dict[int, list] = {}
        for x in items:
            if isinstance(x, dict) and x.get("source_file") == source and x not in by.setdefault(x.get("chunk_index"), []):
                by[x.get("chunk_index")].append(x)
        out = []
        for i in indexes:
            row = {"source_file": source, "chunk_index": i}
            try:
                if len(by.get(i, [])) != 1:
                    raise ValueError("the reply has no item for this chunk, or several")
                out.append(row | {"signals": _signals(by[i][0]), "summary": by[i][0].get("summary") or ""})
            except Exception as e:
                out.append(row | {"error": f"{type(e).__name__}: {e}"})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("source_file", "indexes", "body"))):
                yield from pa.Table.from_pylist(answer(*row), schema=fields).to_batches()

    found = calls.select("source_file", "indexes", "body").mapInArrow(run, schema)
    return chunks.join(found, keys, "left").select(*chunks.columns, "signals", "summary", "error")


def failure_rate(failed: Column) -> Column:
    """Share of failures, 0 for no rows."""
    return F.coalesce(F.avg(failed.cast("int")), F.lit(0.0))


def gate(extracted: DataFrame, most: float = MAX_FAILED) -> dict:
    """Counts of the run; raises if more than `most` of its chunks failed."""
    r = extracted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"), failure_rate(F.col("error").isNotNull()).alias("rate")).first()
    if r.rate > most:
        raise TooManyFailures(f"{r.bad} of {r.n} chunks failed ({r.rate:.0%})")
    return {"n_total_chunks": r.n, "n_failed_chunks": r.bad, "n_chunks": r.n - r.bad, "failure_rate": r.rate}


def condense(signals: DataFrame, keys: list[str], threshold: float = 0.35, most: int = 6) -> DataFrame:
    """The stated rules without a model: equal contents of a category are one, 0.1 more salient if several sources have it
    (1 at most); weak ones go; each category keeps its `most` strongest."""
    merged = signals.groupBy(*keys, "category", "content").agg(F.max("salience").alias("s"), F.countDistinct("source_file").alias("n_sources"), F.count(F.lit(1)).alias("n"))
    lifted = merged.withColumn("salience", F.when(F.col("n_sources") >= 2, F.least(F.lit(1.0), F.round(F.col("s") + 0.1, 6))).otherwise(F.col("s"))).where(F.col("salience") >= threshold)
    place = Window.partitionBy(*keys, "category").orderBy(F.desc("salience"), F.desc("n"), "content")
    return lifted.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most).drop("s")


def batches(distillates: DataFrame, keys: list[str], order: list[str], over: int = BATCH_OVER, size: int = BATCH_SIZE) -> DataFrame:
    """batch_id: 0 for all up to `over` rows, else every `size` rows in order."""
    place, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    return distillates.withColumn("batch_id", F.when(n > over, F.floor((F.row_number().over(place) - 1) / size)).otherwise(F.lit(0)).cast("long"))


def batches_of_all(distillates: DataFrame, order: list[str], over: int = BATCH_OVER, size: int = BATCH_SIZE) -> DataFrame:
    """As batches(), for all rows as one list; no task sorts them all."""
    placed, n = numbered(distillates, *order, name="_n")
    return placed.withColumn("batch_id", F.expr(f"_n div {size}") if n > over else F.lit(0).cast("long")).drop("_n")


def ask_each(requests: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """(batch_id, reply): the model's reply to each `request`, asked in the tasks. Write the result before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, request in zip(batch["batch_id"].to_pylist(), batch["request"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([ask(request)], pa.string())], names=["batch_id", "reply"])

    return requests.select(F.col("batch_id").cast("long").alias("batch_id"), "request").mapInArrow(run, "batch_id long, reply string")


def bundle(distillates: DataFrame, keys: list[str]) -> DataFrame:
    """The text a model condenses, per keys: sources in order of `ord`, their chunks by index, a line per signal."""
    line = lambda s: F.concat(F.lit("    * ["), s["category"], F.lit("] salience="), F.format_number(s["salience"], 2), F.lit("  "), s["content"], F.lit("  «"), s["evidence"], F.lit("»"))
    head = F.concat(F.lit("- 块#"), F.col("chunk_index").cast("string"), F.lit(" ["), F.col("char_start").cast("string"), F.lit("-"), F.col("char_end").cast("string"), F.lit("] 速写: "), F.col("summary"))
    rows = distillates.withColumn("_l", F.array_join(F.concat(F.array(head), F.transform("signals", line)), "\n"))
    files = rows.groupBy(*keys, "source_file").agg(F.min("ord").alias("_o"), F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "ord", "_l"))), lambda x: x["_l"]).alias("_ls"))
    files = files.withColumn("_f", F.concat(F.lit("### 文件 "), "source_file", F.lit("（"), F.size("_ls").cast("string"), F.lit(" 块）\n"), F.array_join("_ls", "\n")))
    return files.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_f"))), lambda x: x["_f"]), "\n").alias("bundle"))


def card_defaults(cards: DataFrame, persona_id: str | None = None) -> DataFrame:
    out = cards.withColumn("error_reply", F.coalesce(F.nullif("error_reply", F.lit("")), F.lit(ERROR_REPLY)))
    return out.withColumn("persona_id", F.lit(persona_id)) if persona_id else out


def evidence_rows(distillates: DataFrame) -> DataFrame:
    """(category, content, evidence) of all signals, in order."""
    return distillates.select("ord", F.posexplode("signals").alias("i", "s")).select(F.struct("ord", "i").alias("ord"), "s.category", "s.content", "s.evidence")


def domains(models: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Adds cross_domain_rule (a keyword of the model is in signals of two categories or more) and proofs, the first four.
    The keywords of all models are looked for together, in one pass over the evidence. A keyword's first four pieces of evidence
    in each category are enough to tell a model's, so that is all that meets the models; Spark cuts them off before the shuffle."""
    asked = models.select(key, F.explode(F.array_distinct(T.keywords(F.concat_ws(" ", "principle", "name")))).alias("word"))
    proof = F.concat(F.lit("["), "category", F.lit("] "), F.substr("evidence", F.lit(1), F.lit(60))).alias("proof")
    hit = occurring(evidence.select("ord", "category", proof, "content", "evidence"), ["content", "evidence"], asked)
    place = Window.partitionBy("word", "category").orderBy("ord")
    first = hit.withColumn("_r", F.row_number().over(place)).where("_r <= 4").drop("_r")
    # of a model: its keywords times the categories times four
    of = asked.join(first, "word").groupBy(key).agg(F.countDistinct("category").alias("n"), F.collect_set(F.struct("ord", "proof")).alias("p"))
    of = of.select(key, "n", F.transform(F.slice(F.array_sort("p"), 1, 4), lambda x: x["proof"]).alias("proofs"))
    return models.join(of, key, "left").withColumn("cross_domain_rule", F.coalesce(F.col("n") >= 2, F.lit(False))).withColumn("proofs", F.coalesce("proofs", F.array().cast("array<string>"))).drop("n")


def verify(models: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The three checks on each model's verification, `passed`, and a reason per check that failed."""
    found = domains(models, evidence, key)
    v = F.col("verification")
    cross = v["cross_domain"] | F.col("cross_domain_rule")
    generative = v["generative"] & ~T.blank(v["generative_example"])
    exclusive = v["exclusive"] & ~T.blank(v["exclusivity_note"])
    kept = F.when(~cross, F.col("proofs")).when(F.size("proofs") > 0, F.col("proofs")).otherwise(v["cross_domain_evidence"])
    new = F.struct(cross.alias("cross_domain"), generative.alias("generative"), exclusive.alias("exclusive"), kept.alias("cross_domain_evidence"), v["generative_example"].alias("generative_example"), v["exclusivity_note"].alias("exclusivity_note"))
    reasons = F.array_compact(F.array(F.when(~cross, "cross_domain"), F.when(~generative, "generative"), F.when(~exclusive, "exclusive")))
    return found.withColumn("reasons", reasons).withColumn("passed", cross & generative & exclusive).withColumn("verification", new).drop("proofs", "cross_domain_rule")


def filter_verified(cards: DataFrame) -> DataFrame:
    """Cards with only the models that pass all three checks."""
    ok = lambda m: m["verification"]["cross_domain"] & m["verification"]["generative"] & m["verification"]["exclusive"]
    return cards.withColumn("mental_models", F.filter("mental_models", ok))


def restrict_skills(skills: DataFrame, cards: DataFrame, key: str = "persona_id") -> DataFrame:
    """Skills keep only models their card has; a card without models leaves them be."""
    names = cards.select(key, F.transform("mental_models", lambda m: m["name"]).alias("_n"))
    own = skills.join(names, key, "left")
    return own.withColumn("mental_models", F.when(F.coalesce(F.size("_n"), F.lit(0)) == 0, F.col("mental_models")).otherwise(F.filter("mental_models", lambda m: F.array_contains("_n", m["name"])))).drop("_n").select(*skills.columns)
