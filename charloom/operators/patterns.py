"""Which of many words occur in texts: one automaton over all words goes through each text once, in Arrow batches. Words too many
for a task's memory are dealt to several automata; with words too long for that, they meet the texts by their first two
characters, and a JVM search decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from charloom.functions.shared import save

#: Characters of all words together up to which an automaton is built in a task.
MOST = 1_000_000


def occurring(rows: DataFrame, texts: list[str], words: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each row and distinct word that one of its texts holds: the row's columns but the texts, and `word`. Null texts
    and empty words hold and are held by nothing. words: a column `word`. Words of more than `most` characters together are
    dealt by hash to as many automata as they need, one after the other; the texts are never shuffled."""
    words = words.select("word").where("word != ''").distinct()
    size, longest = words.agg(F.sum(F.length("word")), F.max(F.length("word"))).first()
    if (size or 0) <= most:
        return by_automaton(rows, texts, words)
    if not size or longest > most // 10:
        return by_heads(rows, texts, words)
    parts = parts_of(words, most)
    rows, dealt = save(rows, "searched"), save(words.withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")), "words")
    found = [save(by_automaton(rows, texts, dealt.where(F.col("_part") == k).select("word")), "found") for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def parts_of(words: DataFrame, most: int = MOST) -> int:
    """Automata that a column `word` of distinct words needs."""
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    return 1 if size <= most else -(-size * 5 // (most * 4))


def by_automaton(rows: DataFrame, texts: list[str], words: DataFrame) -> DataFrame:
    import ahocorasick

    listed = rows.sparkSession.sparkContext.broadcast([r.word for r in words.collect()])
    kept = [f for f in rows.schema.fields if f.name not in texts]
    schema = StructType([*kept, StructField("word", StringType())])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in listed.value:
            automaton.add_word(w, w)
        if listed.value:
            automaton.make_automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                where, found = [], []
                for i, values in enumerate(zip(*(part[t].to_pylist() for t in texts))):
                    held = {w for v in values if v and listed.value for _, w in automaton.iter(v)}
                    where += [i] * len(held)
                    found += sorted(held)
                if found:
                    out = pa.Table.from_batches([part.select([f.name for f in kept])]).take(pa.array(where, pa.int64())) if kept else None
                    columns = [*(out.columns if out else []), pa.array(found, pa.string())]
                    yield from pa.table(columns, schema=fields).to_batches()

    return rows.mapInArrow(run, schema)


def by_heads(rows: DataFrame, texts: list[str], words: DataFrame) -> DataFrame:
    """The same by a hash join: a word meets the texts that hold its first two characters."""
    # a word of one character is its own head
    heads = words.select("word", F.substring("word", 1, 2).alias("_head"))
    kept = [c for c in rows.columns if c not in texts]
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.lit(2)))
    singles = lambda c: F.split(F.col(c), "")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.when(F.length(t) > 0, F.concat(grams(t), singles(t))), none) for t in texts))))
    met = rows.withColumn("_head", F.explode(every)).join(heads, "_head")
    holds = F.lit(False)
    for t in texts:
        holds = holds | F.coalesce(F.contains(F.col(t), F.col("word")), F.lit(False))
    return met.where(holds).select(*kept, "word")
