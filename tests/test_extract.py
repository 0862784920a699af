"""Batches of chunks in one call of the model, and sizes of chunks in tokens."""

import json
import os

import pytest

from charloom.config import Config
from charloom.engine import Engine
from charloom.model import prompts
from charloom.operators import chunking, distill

ROWS = [(f, i, i * 10, i * 10 + 9, 5, f"text {f} {i}", "more") for f, n in (("a.txt", 7), ("b.txt", 2), ("c.txt", 1)) for i in range(n)]
SCHEMA = "source_file string, chunk_index int, char_start int, char_end int, token_count int, text string, extra string"


def model(prompt):
    chunks = json.loads(prompt[prompt.index("\n\n[") :])
    if chunks[0]["source"] == "c.txt":
        raise ConnectionError("no")
    items = []
    for c in chunks:
        item = {"source_file": c["source"], "chunk_index": c["chunk_index"], "char_start": 999, "signals": [{"category": "values", "content": c["text"], "salience": 0.4}], "summary": f"n{len(chunks)}"}
        if (c["source"], c["chunk_index"]) == ("a.txt", 1):
            continue
        if (c["source"], c["chunk_index"]) == ("a.txt", 4):
            item["signals"][0]["category"] = "none such"
        items += [item, item] if c["chunk_index"] == 5 else [item]
    return {"items": [*items, "junk", {"source_file": "other", "chunk_index": 0}]}


@pytest.mark.parametrize("size", [1, 3, 100])
def test_batches(spark, size):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {(r.source_file, r.chunk_index): r for r in distill.extract_batches(df, model, prompts.EXTRACTOR_BATCH, size).collect()}
    assert got.keys() == {(r[0], r[1]) for r in ROWS}
    bad = {k for k, r in got.items() if r.error}
    assert bad == {("a.txt", 1), ("a.txt", 4), ("c.txt", 0)}
    for k, r in got.items():
        assert r.extra == "more" and r.char_start == k[1] * 10
        if k not in bad:
            assert r.signals[0].content == f"text {k[0]} {k[1]}" and r.signals[0].evidence == "" and r.summary == f"n{min(size, 7 - k[1] // size * size) if k[0] == 'a.txt' else min(size, 2)}"
    assert distill.gate(distill.extract_batches(df, model, "x", size))["n_failed_chunks"] == 3


def test_token_count(spark):
    ranks = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    count = chunking.TokenCount(ranks)
    assert count("") == 0 and count("hello hello <|endoftext|>") > 2 and count("a" * 3000) < 3000
    text = "\n\n".join("some plain words in a row " * 8 for _ in range(12))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    by_tokens, by_signs = (chunking.chunk(df, 300, 30, count=c).collect() for c in (count, len))
    assert len(by_tokens) < len(by_signs) and all(r.token_count <= 300 for r in by_tokens)
    assert sum(r.token_count for r in by_tokens[:1]) == sum(count(p) for p in by_tokens[0].text.split("\n\n"))


def test_engine_settings(spark, tmp_path):
    ranks = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    (tmp_path / "t.txt").write_text("words in a row here. " * 300 + "\n\n" + "more. " * 300)
    plain, tokens = (Engine(spark, Config(workdir=str(tmp_path / "w"), token_ranks=r)) for r in ("", ranks))
    docs = plain.load(str(tmp_path / "t.txt"))
    assert tokens.chunks(docs).agg({"token_count": "max"}).first()[0] < plain.chunks(docs).agg({"token_count": "max"}).first()[0]
    assert os.path.isfile(plain.write_method() / "distillation-method" / "SKILL.md")


def test_condense_in_rounds(spark, tmp_path):
    """900 distillates: 45 calls in the tasks, 3 for their cards, one for those; every one of 20 parts at most, in order."""
    log = tmp_path / "log"
    log.mkdir()

    def ask(prompt):
        import uuid

        body = prompt.partition("\n\n")[2]
        seen = [x for x in body.replace("\n", " ").split() if x.startswith("say")] or body.split("\n\n")
        (log / uuid.uuid4().hex).write_text(f"{len(seen)}")
        return json.dumps({"persona_id": "x", "system_prompt": f"<{seen[0].strip('<>').split('..')[0]}..{seen[-1].strip('<>').split('..')[-1]}>"})

    rows = [(1, "f.txt", i, 0, 1, "", [("values", f"say{i:04d}", "e", 0.5)]) for i in range(900)]
    good = spark.createDataFrame(rows, f"schema_version int, source_file string, chunk_index int, char_start int, char_end int, summary string, signals {distill.SIGNALS}").repartition(4)
    good = good.selectExpr("*", "struct(source_file, chunk_index) as ord")
    card = Engine(spark, Config(workdir=str(tmp_path / "w")), ask)._condense(good, "me")
    assert card["persona_id"] == "me" and card["system_prompt"] == "<say0000..say0899>"
    assert sorted(int(f.read_text()) for f in log.iterdir()) == sorted([20] * 45 + [20, 20, 5] + [3])
    few = Engine(spark, Config(workdir=str(tmp_path / "w")), ask)._condense(good.where("chunk_index < 30"), "me")
    assert few["system_prompt"] == "<say0000..say0029>"
