"""Files to documents, the index and its resolution, runs with a fake model, and what lands on disk."""

import json

import pytest
from pyspark.sql import functions as F

from charloom.config import Config
from charloom.engine import Engine
from charloom.model import cocreate, prompts
from charloom.model.client import FakeClient, structured, with_retry
from charloom.operators import distill, index, profile, resolve
from charloom.operators.mentions import ENTRY
from charloom.sources import artifacts, corpus
from charloom.streaming import incremental


@pytest.fixture
def files(tmp_path):
    d = tmp_path / "corpus"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("第一段。\n\n第二段。", encoding="utf-8")
    (d / "b.json").write_text(json.dumps([{"role": "x", "text": "一"}, {"body": 3, "text": "二"}, "三", 4, {"k": 1}]), encoding="utf-8")
    (d / "c.jsonl").write_text('{"utterance": "u"}\nbroken {\n\n"s"\n12\n{"z": true}\n', encoding="utf-8")
    (d / "d.csv").write_text('a,"b,c"\n1,"x\ny"\n', encoding="utf-8")
    (d / "sub" / "e.TSV").write_text("a\tb\n", encoding="utf-8")
    (d / "sub" / "f f+%.md").write_bytes(b"\xff\xfe" + "荒川".encode("utf-16-le"))
    (d / "g.bin").write_bytes(b"\0")
    return d


def test_load(spark, files):
    rows = corpus.load_corpus(spark, str(files)).collect()
    got = {r.relpath: r.text for r in rows}
    assert got == {"a.txt": "第一段。\n\n第二段。", "b.json": '一\n二\n三\n4\n{"k": 1}', "c.jsonl": 'u\nbroken {\ns\n{"z": true}', "d.csv": "a,b,c\n1,x\ny", "sub/e.TSV": "a\tb", "sub/f f+%.md": "荒川"}
    assert [r.relpath for r in rows] == sorted(got, key=lambda p: p.split("/"))
    assert rows[0].size_chars == len(rows[0].text)
    assert corpus.load_corpus(spark, str(files / "g.bin")).count() == 1
    with pytest.raises(ValueError):
        corpus.load_corpus(spark, str(files), max_mb=0.000001)
    assert corpus.load_corpus(spark, str(files), max_mb=0).count() == 6
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, str(files / "none"))
    with pytest.raises(FileNotFoundError):
        corpus.resolve_path("none-such", str(files))


def test_decode():
    t = "荒川善次，你好"
    for raw in (t.encode(), b"\xef\xbb\xbf" + t.encode(), b"\xff\xfe" + t.encode("utf-16-le"), b"\xfe\xff" + t.encode("utf-16-be"), (t + "a").encode("gb18030")):
        assert corpus.decode(raw).rstrip("a") == t


def rows(spark, spec):
    """Entries from (name, category, aliases, others)."""
    return spark.createDataFrame([(f"{i:03}", n, a, c, f"{n} 说 {i}", "s", "c", i, i + 1, i, None, o) for i, (n, c, a, o) in enumerate(spec)], ENTRY)


@pytest.mark.parametrize(
    "spec, merged, pending",
    [
        ([("A", "speech", [], [])], [], 0),
        ([("甲某某某某", "speech", ["乙"], []), ("乙", "speech", [], [])], [], 1),
        ([("荒川善次", "speech", ["荒川"], []), ("荒川", "speech", [], [])], [("荒川", "荒川善次")], 0),
        ([("荒川", "speech", [], [])] * 3 + [("荒川善次", "event", ["荒川"], [])], [("荒川善次", "荒川")], 0),
    ],
)
def test_resolve(spark, spec, merged, pending):
    e = rows(spark, spec)
    r = resolve.resolve(e)
    assert (r.merged, len(r.pending)) == (merged, pending)
    if merged:
        after = index.merge(e, resolve.merge_map(spark, r))
        assert {x.character_name for x in after.collect()} == {merged[0][1]}
        assert not resolve.resolve(e, auto_merge=False).merged and len(resolve.resolve(e, auto_merge=False).pending) == 1


def test_store(spark, tmp_path):
    s = index.IndexStore(spark, f"file://{tmp_path}/i")
    assert s.count() == 0
    e = rows(spark, [("A", "speech", ["a"], []), ("A", "appearance", [], []), ("B", "event", [], [])])
    s.add(e)
    s.add(e.where("uuid = '000'").withColumn("text", F.lit("100% new_")))
    assert s.count() == 3 and index.of_character(s.entries(), "A", "speech").first().text == "100% new_"
    listed = index.characters(s.entries())
    assert [(r.character_name, r.mention_count, r.by_category, r.aliases) for r in listed.collect()] == [("A", 2, {"appearance": 1, "speech": 1}, ["a"]), ("B", 1, {"event": 1}, [])]
    assert [index.resolve_name(x, listed) for x in ("2", "A", "xxB", "9", "", "zz")] == ["B", "A", "B", None, None, None]
    assert s.merge("A", "B") == 2 and s.merge("B", "B") == 0 and s.merge("zz", "B") == 0
    assert {tuple(r.aliases) for r in s.entries().where("uuid < '002'").collect()} == {("a", "A"), ("A",)}
    assert index.search_text(s.entries(), "NEW_").count() == 1 and index.search_text(s.entries(), "说", "B", 1).count() == 1
    s.clear()
    assert s.count() == 0


def test_profile(spark):
    e = rows(spark, [("A", "speech", ["甲"], ["B"]), ("A", "speech", [], ["Bob"]), ("A", "appearance", [], []), ("A", "event", [], []), ("B", "speech", ["Bo", "b"], []), ("Bob", "event", [], [])]).withColumn("text", F.concat("text", F.lit(" Bob B Bo b")))
    e = e.withColumn("relation_to", F.when(F.col("character_name") == "B", "学生"))
    p = profile.profiles(e.where("character_name = 'A'"))
    r = p.first()
    assert (r.mention_count, r.speech_count, r.appearance_count, r.event_count, len(r.speech), r.aliases) == (4, 2, 1, 1, 2, ["甲"])
    people = profile.labels(profile.others(p, index.characters(e), e))
    assert {(x.name, x.label) for x in people.collect()} == {("B", "[学生A]"), ("Bob", "[人物A]")}
    repls = profile.replacements(people, p)
    assert [x.name for x in repls.first().repls] == ["Bob", "Bo", "B"]
    out = profile.rebuilt(p, repls).first()
    assert "[人物[学生A]ob" not in out.speech_md and "> A 说 0 [人物A] [学生A] [学生A] b" in out.speech_md and out.events_md.startswith("# ")
    assert [x.name for x in profile.relationships(people, p).first().relations] == ["[学生A]", "[人物A]"]
    one = [{"uuid": str(i)} for i in range(5)]
    assert [x["uuid"] for x in profile.multi_query(one, ["a", "b"], 4, lambda es, q: es[::-1])] == ["4", "3", "2", "1"]
    assert profile.multi_query(one, ["a"], 2, None) == one[:2] and profile.multi_query(one, ["a"], 2, lambda es, q: 1 / 0) == one[:2]


CARD = {"persona_id": "x", "system_prompt": "[雷区]\n- 迟到 → 生气", "display_name": "荒", "tags": ["t"], "mental_models": [{"name": "看云", "principle": "天气与心情", "verification": {"cross_domain": True, "generative": True, "exclusive": True, "generative_example": "e", "exclusivity_note": "n"}}, {"name": "坏", "principle": "p"}]}
SIGNALS = {"signals": [{"category": "values", "content": "天气与心情", "evidence": "看云", "salience": 0.5}, {"category": "emotion", "content": "看云", "evidence": "e"}], "summary": "s"}
ITEMS = {"items": [{"name": "看云 skill", "description": "d", "mental_models": [{"name": "看云", "principle": "p"}, {"name": "别的", "principle": "q"}]}]}


def fake(prompt):
    if "按类别提取" in prompt:
        return json.dumps(SIGNALS, ensure_ascii=False)
    if "合并同类" in prompt:
        return {"structured_response": CARD}
    if "技能" in prompt:
        return {"messages": [{"content": [{"text": json.dumps(ITEMS, ensure_ascii=False)}]}]}
    if "预设对话" in prompt:
        return '{"items": [{"user": "u", "assistant": "a", "intent": "i"}]}'
    if "score" in prompt:
        return '{"score": 0.85, "reasons": []}'
    if "猜测" in prompt:
        return '{"name": "荒", "confidence": 0.9}'
    return "Q: 1 A: 1\nQ: 2 A: 2"


def test_distill(spark, files, tmp_path):
    e = Engine(spark, Config(workdir=str(tmp_path / "w")), fake)
    out = tmp_path / "out"
    r = e.distill(str(files), "my-persona", str(out), judge=True)
    assert r["card"]["persona_id"] == "my-persona" and [m["name"] for m in r["card"]["mental_models"]] == ["看云"]
    assert r["card"]["anti_patterns"][0]["pattern"] == "迟到" and r["card"]["error_reply"] == distill.ERROR_REPLY
    assert r["metadata"]["n_docs"] == 6 and r["metadata"]["failure_rate"] == 0 and r["metadata"]["eval_report"]["overall_score"] > 0.5
    assert [m["name"] for m in r["skills"][0]["mental_models"]] == ["看云"]
    names = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and "distillates.jsonl" not in str(p)}
    assert names == {"persona_card.json", "persona_card.md", "preset_dialogues.json", "distillation_result.json", "eval_report.json", "skills/my-persona-skill/SKILL.md"}
    assert artifacts.load_result(out)["card"] == r["card"] and artifacts.load_report(out)["fidelity"]["score"] == 0.85
    assert artifacts.personas(tmp_path) == [str(out)]
    assert "无法蒸馏直觉" in (out / "skills/my-persona-skill/SKILL.md").read_text()
    assert artifacts.read_distillates(spark, f"file://{out}/distillates.jsonl").count() == r["metadata"]["n_chunks"]
    assert e.evaluate(r)["overall_score"] > 0 and Engine(spark, Config(workdir=str(tmp_path / "w2"))).evaluate(r)["fidelity"] is None


def test_failures(spark, files, tmp_path):
    n = [0]

    def bad(prompt):
        raise ValueError("no")

    with pytest.raises(distill.TooManyFailures, match="100%"):
        Engine(spark, Config(workdir=str(tmp_path / "w")), bad).distill(str(files))
    rows = spark.createDataFrame([(i, "x" if i < n else None) for n in [2] for i in range(10)], "i int, error string")
    assert distill.gate(rows)["failure_rate"] == 0.2


def test_intake(spark, files, tmp_path):
    e = Engine(spark, Config(workdir=str(tmp_path / "w")))
    (files / "n.txt").write_text("荒川 在家。\n\n荒川 出门，小明 跟着。", encoding="utf-8")
    found = e.mentions(e.chunks(e.load(str(files / "n.txt"))))
    assert e.index(found) > 0 and e.index(found) == 0
    assert "荒川" in {r.character_name for r in e.characters().collect()}
    assert e.entries("荒川").count() == 2 and e.search("小明").count() >= 1
    batch = {"items": [{"chunk_meta": {"source": "s", "chunk_index": "2", "char_start": "x", "corpus_uuid": "c"}, "mentions": [{"name": "N", "category": "speech", "evidence": "e"}, "junk"]}, "junk"]}
    assert e.index_batch(json.dumps(batch)) == 1
    asked = Engine(spark, Config(workdir=str(tmp_path / "v")), lambda p: '{"mentions": [{"name": "荒川", "category": "speech", "evidence": "在家"}, {"name": "假", "category": "speech", "evidence": "没有的话"}]}')
    assert [r.name for r in asked.mentions(asked.chunks(asked.load(str(files / "n.txt")))).collect()] == ["荒川"]
    assert asked.index(asked.mentions(asked.chunks(asked.load(str(files / "n.txt"))))) == 1
    assert sorted(p.name for p in asked.rebuild("荒川", str(tmp_path / "r"))) == ["appearance.md", "events.md", "relationships.json", "speech.md", "summary.md"]


def test_cocreate(tmp_path):
    s = cocreate.Setting("荒", age="十七")
    ask = FakeClient({"采访": "问题？"}, "答")
    assert cocreate.write_corpus(s, str(tmp_path), "p", ask)["chars"] == dict.fromkeys(prompts.OC, 1)
    r = cocreate.interview(s, 3, str(tmp_path), "p", ask)
    assert r["rounds"] == 3 and (tmp_path / "p" / "interview.md").read_text().count("**问**") == 3
    with pytest.raises(FileNotFoundError):
        cocreate.interview(s, 1, str(tmp_path), "none", ask)


def test_client():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert with_retry(flaky, sleep=lambda s: None)() == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=lambda s: None)()
    assert structured({"messages": ["说{我们}", '{"a": 1} {"b": 2}', "no"]}, dict) == {"a": 1}
    with pytest.raises(ValueError):
        structured({"messages": []}, dict)


def test_artifacts(tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        artifacts.check_card({"persona_id": "a", "system_prompt": "b", "extra": 1})
    assert artifacts.skill_names("P", ["x", "x", "技", "技"]) == ["p-x", "p-x-2", "p-skill-2", "p-skill-3"]
    (tmp_path / "distillation_result.json").write_text('{"schema_version": 2}')
    with pytest.raises(artifacts.SchemaVersionError):
        artifacts.load_result(tmp_path)
    (tmp_path / "distillation_result.json").write_text('{"persona_id": "a", "system_prompt": "b"}')
    assert artifacts.load_result(tmp_path)["card"]["persona_id"] == "a"
    with pytest.raises(FileNotFoundError):
        artifacts.load_report(tmp_path)
    assert "（无）" in artifacts.card_markdown({"persona_id": "a", "system_prompt": "b"}) and artifacts.dna_markdown({}) == "- （待提炼）"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("c", str(i % 4), "h") for i in range(8)], "corpus_uuid string, chunk_uuid string, content_hash string")
    src, done = f"file://{tmp_path}/in", f"file://{tmp_path}/done"
    rows.where("chunk_uuid < '2'").write.mode("append").parquet(src)

    def run():
        def work(df, n):
            df.write.mode("overwrite").parquet(f"{done}/batch={n}")

        incremental.stream_new_chunks(spark.readStream.schema(rows.schema).parquet(src), f"file://{tmp_path}/cp", work).awaitTermination()

    run()
    assert spark.read.parquet(done).count() == 2
    rows.where("chunk_uuid >= '2'").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.chunk_uuid for r in spark.read.parquet(done).collect()) == ["0", "1", "2", "3"]


def test_config(monkeypatch):
    with pytest.raises(ValueError):
        Config(model="real", offline=False)
    monkeypatch.setenv("CHARLOOM_CHUNK_TOKENS", "99")
    assert Config.from_env().chunk_tokens == 99


def test_digest_and_addresses(spark):
    from charloom.model import embed
    from charloom.model.http import HttpClient
    from charloom.operators import evaluate

    text = evaluate.card_digest(CARD)
    assert "- 看云：天气与心情（cross_domain=True, generative=True, exclusive=True）" in text and "- rhythm: (空)" in text
    assert HttpClient("local:m").address() == ("http://127.0.0.1:8000/v1/chat/completions", "m")
    assert HttpClient("m", base_url="http://x/").address() == ("http://x/chat/completions", "m")
    assert len(embed.hash_embedder(8)(spark.createDataFrame([("t",)], "text string")).first().embedding) == 8
    assert embed.build_embedder() is None and embed.build_reranker() is None


def plain_fold(listed, hits_of, auto_merge):
    """All pairs in list order."""
    names = sorted(listed, key=lambda n: (-listed[n][0], n))
    counts, aliases = {n: c for n, (c, _) in listed.items()}, {n: set(a) for n, (_, a) in listed.items()}
    merged, pending, gone = [], [], set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a in gone or b in gone:
                continue
            hits = (b in aliases[a] or a in aliases[b]) + hits_of.get((a, b), 0)
            if hits >= 2 and auto_merge:
                a_wins = counts[a] > counts[b] if counts[a] != counts[b] else len(a) >= len(b)
                target, source = (a, b) if a_wins else (b, a)
                merged.append((source, target))
                gone.add(source)
                aliases[target] = (aliases[target] | aliases[source] | {source}) - {target}
                counts[target] += counts[source]
            elif hits:
                pending.append((a, b, hits))
    return merged, pending


def test_fold():
    import random

    r = random.Random(5)
    for _ in range(3000):
        names = [f"{'n' * r.randint(1, 3)}{i}" for i in range(r.randint(0, 9))]
        listed = {n: (r.randint(1, 4), set(r.sample([*names, "x"], min(len(names), r.randint(0, 3)))) - {n}) for n in names}
        ordered = sorted(names, key=lambda n: (-listed[n][0], n))
        hits_of = {(a, b): r.randint(0, 2) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if r.random() < 0.3}
        for auto in (True, False):
            got = resolve.fold(listed, hits_of, auto)
            assert (got.merged, got.pending) == plain_fold(listed, hits_of, auto)


def test_env(tmp_path, monkeypatch):
    from charloom.config import Config

    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# note\nCHARLOOM_TOP_K=7\nexport CHARLOOM_AUTO_MERGE='no'\nCHARLOOM_MODEL=fake\n", encoding="utf-8")
    for name in ("CHARLOOM_TOP_K", "CHARLOOM_AUTO_MERGE", "CHARLOOM_MODEL"):
        monkeypatch.setenv(name, "")
        monkeypatch.delenv(name)
    monkeypatch.setenv("CHARLOOM_MAX_SKILLS", "2")
    found = Config.from_env()
    assert (found.top_k, found.auto_merge, found.offline, found.max_skills) == (7, False, True, 2)


def test_method(tmp_path):
    text = (artifacts.write_method(tmp_path / "skills") / "distillation-method" / "SKILL.md").read_text(encoding="utf-8")
    assert text.startswith("---\nname: distillation-method\n")
