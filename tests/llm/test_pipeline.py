"""The pipeline against a plain version of each stage."""

import random
import re

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from charloom.llm import bpe, quality, secrets

from .test_sets import plain_jaccard


def planted(spark, sf, folder):
    """The tables with documents of shuffled words that hold secrets, in a folder of their own."""
    rnd, docs = random.Random(6), spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda n: "a7" + "".join(rnd.choices("abcdefXYZ0123456789", k=n))
    prose = [r.text.split()[:200] for r in docs.where("length(text) > 1500").orderBy("doc_id").limit(6).collect()]
    rows = []
    for k, words in enumerate(prose):
        rnd.shuffle(words)
        half = len(words) // 2
        rows.append((10_000 + k, f"{' '.join(words[:half])} the private key {key(700)} or password = {key(9)}, {' '.join(words[half:])}", "en", "planted", 0))
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*docs.columns))
    more.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, sf, tmp_path):
    sf = planted(spark, sf, str(tmp_path / "planted"))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = []
    for i, r in sorted(docs.items()):
        words, m = quality.base_measures(r.text or "")
        if not quality.base_failed(m) and not any(f(words, m) for f in quality.RULES.values()):
            kept.append((i, r.text))
    least = {i: c for i, _, c in plain_jaccard(kept)}
    kept = [(i, t) for i, t in kept if least[i] == i]
    kept = [(i, t) for i, t in kept if not any(x in plain(t) for x in items)]
    encode = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    dictionary = secrets.learn_identifiers(spark.createDataFrame(kept, "doc_id long, text string"))
    novelty = secrets.Novelty(dictionary)
    want = {i: secrets.masked(t, secrets.find(t, novelty)[1], "<secret>") for i, t in kept}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want) and sum(t != docs[i].text for i, t in want.items()) == 6
    for i, t in want.items():
        assert bytes(got[i].ids) == encode(t) and got[i].n_tokens == len(encode(t)) // 4


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_odd_tables(spark, sf, odd):
    """Null ids and texts, repeated ids of different texts, long texts and clashing names; empty tables."""
    more = odd.unionByName(odd.where("doc_id in (5, 8, 11)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id in (8, 9)").withColumn("doc_id", F.lit(11).cast("long")))
    for docs in (more, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count()
        n = docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n
