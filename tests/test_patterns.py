"""Words in texts by the automaton and by the join, and the domain counts that follow, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from charloom.operators import distill, patterns

TEXTS = [None, "", "ab", "abcabc", "xaby", "荒川善次在家", "川", "🙂a🙂", "Ab aB", "a" * 50, "no"]
WORDS = ["ab", "abc", "bca", "荒川", "川", "🙂", "🙂a🙂", "", "aaaa", "zz", "ab"]


@pytest.mark.parametrize("way", [patterns.by_automaton, patterns.by_heads])
def test_occurring(spark, way):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choices("abc川", k=rnd.randrange(12))) for _ in range(60)]
    rows = [(i, texts[i], texts[-1 - i], i * 2) for i in range(len(texts))]
    df = spark.createDataFrame(rows, "id int, one string, two string, more int").repartition(3)
    words = spark.createDataFrame([(w,) for w in WORDS], "word string").where("word != ''").distinct()
    got = sorted(map(tuple, way(df, ["one", "two"], words).select("id", "more", "word").collect()))
    assert got == sorted((i, m, w) for i, a, b, m in rows for w in set(WORDS) - {""} if w in (a or "") or w in (b or ""))


def test_occurring_without_words(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    none = spark.createDataFrame([], "word string")
    assert patterns.occurring(df, ["text"], none).count() == 0
    assert patterns.occurring(df, ["text"], none, most=-1).count() == 0


def plain_domains(models, evidence):
    out = {}
    for key, name, principle in models:
        words = re.findall(r"[一-龥]{2,}|[A-Za-z]{3,}", f"{principle} {name}")
        hits = [(c, e) for c, content, e in evidence if any(w in content or w in e for w in words)]
        out[key] = (len({c for c, _ in hits}) >= 2, [f"[{c}] {e[:60]}" for c, e in hits[:4]])
    return out


@pytest.mark.parametrize("most", [patterns.MOST, 0])
def test_domains(spark, monkeypatch, most):
    monkeypatch.setattr(patterns.occurring, "__defaults__", (most,))
    rnd = random.Random(7)
    words = ["apple", "banana", "cherry", "damson", "天气", "心情", "看云", "to", "xx", "elder"]
    text = lambda k: " ".join(rnd.choices(words, k=k))
    models = [(i, rnd.choice(["Model", "看云", "x"]), text(rnd.randrange(3)) if i % 6 else "...") for i in range(40)]
    evidence = [(rnd.choice(["values", "emotion", "taboo"]), text(rnd.randrange(4)), text(2)) for _ in range(60)]
    m = spark.createDataFrame(models, "k int, name string, principle string")
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(evidence)], "ord int, category string, content string, evidence string").repartition(3)
    got = {r.k: (r.cross_domain_rule, r.proofs) for r in distill.domains(m, e, "k").collect()}
    assert got == plain_domains(models, evidence)


def test_domains_have_no_loop_join(spark):
    """However many models, evidence and keywords meet by equality."""
    m = spark.range(20_000).select(F.col("id").alias("k"), F.lit("M").alias("name"), F.concat(F.lit("word"), F.col("id")).alias("principle"))
    e = spark.createDataFrame([(1, "values", "word", "x")], "ord int, category string, content string, evidence string")
    plan = distill.domains(m, e, "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_of_several_automata(spark, monkeypatch):
    """Words too many for one automaton are dealt to several; texts don't meet words by their heads."""
    monkeypatch.setattr(patterns, "by_heads", None)
    words = [f"w{i}" for i in range(60)] + ["b", "荒川"]
    texts = [(0, "w1w22 荒川"), (1, None), (2, "abw59"), (3, "")]
    df, listed = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame([(w,) for w in words], "word string")
    want = {(i, w) for i, t in texts for w in words if t and w in t}
    got = [tuple(r) for r in patterns.occurring(df, ["text"], listed, most=60).collect()]
    assert len(got) == len(want) and set(got) == want
