"""The index on disk against the plain table: writes touch what they change, searches read less and find the same."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from charloom.operators import index, index_store
from charloom.operators.mentions import ENTRY


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    words = "the old Bridge über 荒川 100% new_ river a-b House of stone".split()
    return [{"uuid": f"{i:05d}", "character_name": rnd.choice(["Anna", "Bert", "荒川", "Dora", f"N{i % 40}"]), "category": "speech", "source": "s", "text": " ".join(rnd.choices(words, k=rnd.randrange(8))) if i % 11 else None, "corpus_uuid": f"c{i % 3}", "relation_to": None, "chunk_index": i % 20, "char_start": i, "char_end": i + 1, "aliases": [], "co_mentioned": []} for i in range(n)]


def frame(spark, rows):
    schema = spark.createDataFrame([], ENTRY).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def as_set(df):
    return sorted((r.uuid, r.character_name, r.category, r.text, tuple(r.aliases)) for r in df.collect())


@pytest.fixture()
def store(spark, tmp_path):
    s = index_store.IndexStore(spark, f"file://{tmp_path}/i", buckets=16)
    s.add(frame(spark, rows_of(400)))
    return s


def files(tmp_path, kind="entries"):
    return {p: p.stat().st_size for p in (tmp_path / "i" / kind).rglob("*.parquet")}


def test_writes_follow_the_change(spark, store, tmp_path):
    plain = frame(spark, rows_of(400))
    assert as_set(store.entries()) == as_set(plain)
    before, old, first = files(tmp_path), store.entries(), store.manifest()
    was = as_set(old)
    # one entry anew, and one that takes another's place under another name
    new = frame(spark, [rows_of(400)[7] | {"character_name": "Zoe", "text": "moved"}, rows_of(1)[0] | {"uuid": "99999", "character_name": "Zoe"}])
    store.add(new)
    plain = index.upsert(plain, new)
    assert as_set(store.entries()) == as_set(plain)
    made = set(files(tmp_path)) - set(before)
    assert {p.parent.name for p in made} == {f"bucket={b}" for b in {b for b in store.manifest()["entries"] if store.manifest()["entries"][b] != first["entries"].get(b)}}
    assert len({p.parent.name for p in made}) <= 2 and sum(files(tmp_path)[p] for p in made) < 0.4 * sum(before.values())
    # a reader of the version before isn't disturbed
    assert as_set(old) == was
    assert store.merge("Anna", "Bert") == plain.where("character_name = 'Anna'").count() > 0
    plain = index.merge(plain, spark.createDataFrame([("Anna", "Bert")], "source string, target string"))
    assert as_set(store.entries()) == as_set(plain) and as_set(store.entries("Bert")) == as_set(plain.where("character_name = 'Bert'"))
    chunks = spark.createDataFrame([("c1", "s", 4), ("c2", "s", 5), ("none", "s", 1)], "corpus_uuid string, source string, chunk_index int")
    n = plain.count()
    plain = index.delete_chunk(plain, chunks)
    assert store.delete_chunk(chunks) == n - plain.count() > 0 and store.delete_chunk(chunks) == 0
    assert as_set(store.entries()) == as_set(plain)
    version = store.manifest()["version"]
    assert store.merge("Bert", "Bert") == 0 and store.merge("nobody", "Bert") == 0 and store.manifest()["version"] == version
    # folders of old versions go
    assert len(list((tmp_path / "i" / "versions").glob("*.json"))) == 2
    store.clear()
    assert store.count() == 0 and store.search_text("the").count() == 0


def test_two_writers(spark, store):
    now = store.manifest()
    store.add(frame(spark, [rows_of(1)[0] | {"uuid": "a1"}]))
    with pytest.raises(index_store.ConcurrentWrite):
        store._commit(dict(now, version=now["version"] + 1), now)
    assert store.count() == 401


@pytest.mark.parametrize("query", ["bridge", "OLD bRI", "über", "荒川", "100%", "w_ r", "st", "%", "zzz", "nna", "the%river", "a-b", "N1", "_ri_ge o"])
@pytest.mark.parametrize("name", [None, "Anna"])
def test_search_text(store, query, name):
    found = lambda df: [r.uuid for r in df.collect()]
    assert found(store.search_text(query, name, 1000)) == found(index.search_text(store.entries(), query, name, 1000))


def test_search_reads_less(spark, store, tmp_path):
    store.add(frame(spark, [rows_of(1)[0] | {"uuid": "rare", "character_name": "Quentin", "text": "a xylophone"}]))
    found = store.search_text("xylo")
    assert [r.uuid for r in found.collect()] == ["rare"]
    assert len([f for f in found.inputFiles() if "/entries/" in f]) < len([f for f in store.entries().inputFiles()])


def vector_of(text):
    rng = np.random.default_rng(sum(map(ord, text)) % 997)
    centre = np.random.default_rng(sum(map(ord, text)) % 9).normal(size=8)
    return [float(x) for x in centre + 0.5 * rng.normal(size=8)]


def test_vectors(spark, tmp_path):
    texts = [f"t{i * 37}" for i in range(600)]
    rows = [rows_of(1)[0] | {"uuid": f"{i:05d}", "character_name": f"N{i % 30}", "text": t} for i, t in enumerate(texts)]
    embed = lambda df: df.withColumn("embedding", F.udf(vector_of, "array<double>")("text"))
    s = index_store.IndexStore(spark, f"file://{tmp_path}/i", buckets=8, embed=embed)
    s.add(frame(spark, rows))
    whole = embed(s.entries())

    def plain(v, name=None, k=10):
        return [r.uuid for r in index.search_vector(whole, v, name, k).collect()]

    hits, fewer = 0, 0
    for t in texts[:20]:
        v = vector_of(t)
        exact = [r.uuid for r in s.search_vector(v).collect()]
        assert exact == plain(v)
        near = s.search_vector(v, probes=8)
        hits += len({r.uuid for r in near.collect()} & set(exact))
    assert len(s.manifest()["centres"]) == 24 and hits >= 0.9 * 200
    assert [r.uuid for r in s.search_vector(vector_of("x"), "N3", 5).collect()] == plain(vector_of("x"), "N3", 5)
    # a change rewrites its cells only
    before = s.manifest()
    s.add(frame(spark, [rows[5] | {"text": "changed"}]))
    after = s.manifest()
    assert 1 <= sum(after["vectors"].get(c) != f for c, f in before["vectors"].items()) <= 2 and after["centres"] == before["centres"]
    whole = embed(s.entries())
    assert [r.uuid for r in s.search_vector(vector_of("changed"), k=3).collect()] == plain(vector_of("changed"), k=3)
    # merges leave vectors alone, deletions take theirs
    s.merge("N3", "N4")
    assert s.manifest()["vectors"] == after["vectors"]
    # lost vectors come back from the entries
    import shutil

    shutil.rmtree(tmp_path / "i" / "vectors")
    whole = embed(s.entries())
    assert [r.uuid for r in s.search_vector(vector_of("t37")).collect()] == plain(vector_of("t37"))
    assert s.recover_vectors() == 600
    s.delete_chunk(s.entries().select("corpus_uuid", "source", "chunk_index").distinct())
    assert s.count() == 0 and s.search_vector(vector_of("t37")).count() == 0


def test_signatures_cost_no_rows(spark, store, tmp_path):
    """All tables of an index together have as many rows as there are entries, and signatures leave no entry out."""
    import pyarrow.parquet as pq

    assert sum(pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "i").rglob("*.parquet")) == 400
    plain = frame(spark, rows_of(400))
    for query in ("BRIDGE", "über", "荒川", "ston%idge", "new_ riv", "100%", "Dora", "zzz", "N1"):
        assert as_set(store.search_text(query, k=1000)) == as_set(index.search_text(plain, query, k=1000)), query
    texts = ["", "ab", "ABC", "xüberx", None, "荒川"]
    bits = index_store.signatures([index_store.pa.array(["pad", *texts]).slice(1), index_store.pa.array([None] * 6, "string")])
    for part in ("abc", "über", "荒川"):
        want = index_store.signatures([index_store.pa.array([part])])[0]
        held = [(b & want == want).all() for b in bits]
        assert all(h for h, t in zip(held, texts) if part in (t or "").lower()) and not any(held[:2]) and not held[4]
