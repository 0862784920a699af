"""Queries over the character index, similarity, profiles, distillation, prompts and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charloom.functions import similarity as S
from charloom.functions import text as T
from charloom.functions.shared import save, shared_dir
from charloom.operators import chunking, distill, dna, evaluate, index, names, profile, resolve
from charloom.streaming import incremental

from .registry import query
from .text_queries import NAMES, name_rows, read

# entries: a row per capitalised word of the documents

CATEGORY = "CASE doc_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'appearance' ELSE 'event' END"
ENTRIES = f"WITH {NAMES}, entries AS (SELECT doc_id, source, name AS character_name, {CATEGORY} AS category, lower(name) AS alias FROM m WHERE name NOT IN ('The', 'And'))"


def entries(spark, sf) -> DataFrame:
    rows = name_rows(spark, sf).withColumn("category", F.expr(CATEGORY)).withColumn("aliases", F.array(F.lower("name")))
    return rows.select(
        F.concat_ws(":", "doc_id", "mention_start").alias("uuid"), F.col("name").alias("character_name"), "aliases", "category", F.col("evidence").alias("text"), "source", F.col("source").alias("corpus_uuid"),
        F.col("mention_start").cast("int").alias("char_start"), F.col("mention_end").cast("int").alias("char_end"), F.col("doc_id").cast("int").alias("chunk_index"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("relation_to"), F.array("lang").alias("co_mentioned"),
    )


@query("character_list", ENTRIES + " SELECT character_name, count(*) AS mention_count, count(*) FILTER (category = 'speech') AS speech, lower(character_name) AS aliases FROM entries GROUP BY ALL")
def character_list(spark, sf):
    return index.characters(entries(spark, sf)).select("character_name", "mention_count", F.coalesce(F.try_element_at("by_category", F.lit("speech")), F.lit(0)).alias("speech"), F.array_join("aliases", ",").alias("aliases"))


@query("character_entries", ENTRIES + " SELECT doc_id::INT AS chunk_index, count(*) AS n FROM entries WHERE character_name = 'That' AND category = 'event' GROUP BY ALL")
def character_entries(spark, sf):
    return index.of_character(entries(spark, sf), "That", "event").groupBy("chunk_index").agg(F.count(F.lit(1)).alias("n"))


@query("merge_apply", ENTRIES + " SELECT CASE character_name WHEN 'That' THEN 'This' WHEN 'For' THEN 'From' ELSE character_name END AS character_name, CASE WHEN character_name IN ('That', 'For') THEN lower(character_name) || ',' || character_name ELSE lower(character_name) END AS aliases, count(*) AS n FROM entries GROUP BY ALL")
def merge_apply(spark, sf):
    pairs = spark.createDataFrame([("That", "This"), ("For", "From"), ("Was", "Was")], "source string, target string")
    return index.merge(entries(spark, sf), pairs).groupBy("character_name", F.array_join("aliases", ",").alias("aliases")).agg(F.count(F.lit(1)).alias("n"))


@query("index_upsert", ENTRIES + " SELECT category, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE category END AS category FROM entries) GROUP BY ALL")
def index_upsert(spark, sf):
    now = entries(spark, sf)
    return index.upsert(now, now.where("chunk_index % 7 = 0").withColumn("category", F.lit("new"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("delete_chunk", ENTRIES + " SELECT source, count(*) AS n FROM entries WHERE doc_id % 4 <> 1 GROUP BY ALL")
def delete_chunk(spark, sf):
    now = entries(spark, sf)
    return index.delete_chunk(now, now.where("chunk_index % 4 = 1")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


FOUND = """WITH a AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS n, regexp_split_to_array(text, '[A-Z][a-z]{2,}') AS g FROM documents),
b AS (SELECT doc_id, text, unnest(n) AS name, unnest(list_transform(g[:len(n)], lambda x: length(x))) AS gap, generate_subscripts(n, 1) AS i FROM a),
c AS (SELECT *, (sum(gap) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(name)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s FROM b),
e AS (SELECT doc_id::INT AS chunk_index, name AS character_name, s AS char_start, substr(text, greatest(0, s - 20) + 1, s + length(name) + 40 - greatest(0, s - 20)) AS text FROM c WHERE name NOT IN ('The', 'And'))"""


@query("keyword_search", FOUND + " SELECT character_name, chunk_index, char_start, text FROM e WHERE contains(lower(character_name), 'hei') OR contains(lower(text), 'hei') ORDER BY character_name, chunk_index, char_start LIMIT 10")
def keyword_search(spark, sf):
    """By name or by text, over all entries; the limit is the search's own."""
    return index.search_text(entries(spark, sf), "hEI", k=10).select("character_name", "chunk_index", "char_start", "text")


def stored(spark, sf, embed=None) -> index.IndexStore:
    """An index on disk, in a folder of its own."""
    return index.IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", embed=embed)


@query("index_search", FOUND + " SELECT character_name, chunk_index, char_start, text FROM e WHERE contains(lower(character_name), 'ation') OR contains(lower(text), 'ation') ORDER BY character_name, chunk_index, char_start LIMIT 10")
def index_search(spark, sf):
    """By the trigrams of the index on disk."""
    s = stored(spark, sf)
    s.add(entries(spark, sf))
    return s.search_text("aTion", k=10).select("character_name", "chunk_index", "char_start", "text")


@query("index_writes", FOUND + """, m AS (SELECT CASE character_name WHEN 'That' THEN 'This' WHEN 'For' THEN 'From' ELSE character_name END AS character_name, CASE WHEN chunk_index % 7 = 0 THEN 'new' WHEN chunk_index % 3 = 0 THEN 'speech' WHEN chunk_index % 3 = 1 THEN 'appearance' ELSE 'event' END AS category,
  lower(character_name) || CASE WHEN character_name IN ('That', 'For') THEN ',' || character_name ELSE '' END AS aliases, chunk_index, char_start, sha256(text) AS text FROM e WHERE chunk_index % 4 <> 1) SELECT * FROM m""")
def index_writes(spark, sf):
    """Entries after they are added, some are replaced, names are merged and chunks deleted; each write is a version on disk."""
    s, now = stored(spark, sf), entries(spark, sf)
    s.add(now)
    s.add(now.where("chunk_index % 7 = 0").withColumn("category", F.lit("new")))
    s.merge_all(spark.createDataFrame([("That", "This"), ("For", "From"), ("Was", "Was")], "source string, target string"))
    s.delete_chunk(now.where("chunk_index % 4 = 1"))
    return s.entries().select("character_name", "category", F.array_join("aliases", ",").alias("aliases"), "chunk_index", "char_start", F.sha2("text", 256).alias("text"))


COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("vector_topk", f"SELECT vec_id, round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings ORDER BY {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    probe = e.where("vec_id = 0").first().embedding
    rows = e.withColumn("uuid", F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    return index.search_vector(rows, probe, k=10).select("vec_id", F.round("score", 6).alias("score"))


@query("index_vectors", f"SELECT vec_id, round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings ORDER BY {COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')} DESC, vec_id LIMIT 10")
def index_vectors(spark, sf):
    """The exact search of the index on disk, over all its cells."""
    e = read(spark, sf, "embeddings")
    known = e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("uuid"), F.col("label").cast("string").alias("character_name"), F.lit("t").alias("text"), F.col("vec_id").cast("int").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    s = stored(spark, sf, lambda rows: rows.join(known.select("uuid", "embedding"), "uuid"))
    s.add(known.drop("embedding"))
    return s.search_vector(list(e.where("vec_id = 0").first().embedding), k=10).select(F.col("chunk_index").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


@query("vector_pairs", f"SELECT x.vec_id AS a, y.vec_id AS b, round({COS.format(a='x.embedding', b='y.embedding')}, 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {COS.format(a='x.embedding', b='y.embedding')} >= 0.4")
def vector_pairs(spark, sf):
    """All pairs of vectors with a cosine of 0.4 or more, by the join that resolution uses for mean vectors."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return resolve.vector_pairs(rows, 0.4).select(F.col("oa").alias("a"), F.col("ob").alias("b"), F.round("embedding_score", 6).alias("score"))


# similarity: all names; the SQL works all pairs of them out

NAMED = ENTRIES + ", o AS (SELECT character_name AS name, count(*) AS c FROM entries GROUP BY ALL)"
FIRST = "(x.c > y.c OR x.c = y.c AND x.name < y.name)"
JW = "(SELECT j + 0.1 * p * (1 - j) FROM (SELECT jaro_similarity({a}, {b}) AS j, CASE WHEN {a}[1:4] = {b}[1:4] AND least(length({a}), length({b})) >= 4 THEN 4 WHEN {a}[1:3] = {b}[1:3] THEN 3 WHEN {a}[1:2] = {b}[1:2] THEN 2 WHEN {a}[1] = {b}[1] THEN 1 ELSE 0 END AS p))"
JW_AB = JW.format(a="x.name", b="y.name")
ALIKE = f"{NAMED}, p AS MATERIALIZED (SELECT x.name AS a, y.name AS b, x.c AS ca, y.c AS cb, levenshtein(x.name, y.name) AS lev, {JW_AB} AS jw FROM o x JOIN o y ON {FIRST} WHERE abs(length(x.name) - length(y.name)) <= 2 AND levenshtein(x.name, y.name) <= 2 OR {JW_AB} >= 0.85)"


def all_names(spark, sf) -> DataFrame:
    return save(resolve.listed(entries(spark, sf)), "names")


@query("name_pairs", f"{ALIKE} SELECT a, b FROM p")
def name_pairs(spark, sf):
    return resolve.string_pairs(all_names(spark, sf)).select("a", "b")


@query("jaro_winkler", f"{ALIKE} SELECT a, b, round(jw, 6) AS jw FROM p WHERE lev <= 2")
def jaro_winkler(spark, sf):
    """Of the names within two edits of each other."""
    return names.within_two_edits(all_names(spark, sf)).select("a", "b", F.round(S.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jw"))


@query("resolve_decisions", f"{ALIKE} SELECT a, b, CASE WHEN ca <> cb THEN CASE WHEN ca > cb THEN a ELSE b END WHEN length(a) >= length(b) THEN a ELSE b END AS target, 'pending' AS action FROM p")
def resolve_decisions(spark, sf):
    return resolve.decide(resolve.signals(None, names=all_names(spark, sf))).select("a", "b", "target", "action")


def short_aliases(spark, sf) -> DataFrame:
    """Entries whose aliases are the name without its last character, and without its first ones where that makes a name."""
    head = F.expr("substring(character_name, 1, length(character_name) - 1)")
    return entries(spark, sf).withColumn("aliases", F.array(head, F.initcap(F.expr("substring(character_name, 3)"))))


@query("resolve_merges")
def resolve_merges(spark, sf):
    """Merges of names whose aliases are names too, in the order they are decided; the tests hold them against the plain rule."""
    return resolve.resolve(short_aliases(spark, sf)).merges.select("source", "target", "final")


@query("resolve_waiting")
def resolve_waiting(spark, sf):
    return resolve.resolve(short_aliases(spark, sf)).waiting.select("a", "b", "hits")


MEANS = "k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, vec_id) AS r FROM embeddings), v AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM k WHERE r <= 5), mean AS (SELECT label, p, avg(v) AS v FROM v GROUP BY ALL)"


def label_means(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("character_name"), F.expr("CASE vec_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'appearance' ELSE 'event' END").alias("category"), F.col("vec_id").alias("chunk_index"), F.lit(0).alias("char_start"), F.lit("t").alias("text"), "embedding")
    return resolve.mean_embeddings(rows)


@query("mean_embedding", f"WITH {MEANS} SELECT label::VARCHAR AS character_name, (p - 1)::INT AS p, round(v, 6) AS v FROM mean")
def mean_embedding(spark, sf):
    return label_means(spark, sf).select("character_name", F.posexplode("vector").alias("p", "v")).withColumn("v", F.round("v", 6))


@query("label_cosine", f"WITH {MEANS}, l AS (SELECT label, list(v ORDER BY p) AS u FROM mean GROUP BY label) SELECT x.label::VARCHAR AS a, y.label::VARCHAR AS b, round({COS.format(a='x.u', b='y.u')}, 6) AS score FROM l x JOIN l y ON x.label::VARCHAR < y.label::VARCHAR")
def label_cosine(spark, sf):
    m = label_means(spark, sf)
    a, b = m.select(F.col("character_name").alias("a"), F.col("vector").alias("u")), m.select(F.col("character_name").alias("b"), F.col("vector").alias("w"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(S.cosine(F.col("u"), F.col("w")), 6).alias("score"))


@query(
    "near_dup_vectors",
    f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    near AS (SELECT y.label, y.n, list(x.n) AS l FROM e x JOIN e y ON x.label = y.label AND x.n < y.n AND {COS.format(a='x.embedding', b='y.embedding')} >= 0.4 GROUP BY ALL),
    walk AS (SELECT label, 0::BIGINT AS n, []::BIGINT[] AS gone FROM (SELECT DISTINCT label FROM e)
      UNION ALL SELECT w.label, e.n, CASE WHEN near.l IS NOT NULL AND len(list_filter(near.l, lambda v: NOT list_contains(w.gone, v))) > 0 THEN list_append(w.gone, e.n) ELSE w.gone END
      FROM walk w JOIN e ON e.label = w.label AND e.n = w.n + 1 LEFT JOIN near ON near.label = e.label AND near.n = e.n)
    SELECT e.vec_id FROM e JOIN (SELECT label, arg_max(gone, n) AS gone FROM walk GROUP BY label) g ON g.label = e.label WHERE NOT list_contains(g.gone, e.n)""",
)
def near_dup_vectors(spark, sf):
    rows = read(spark, sf, "embeddings").withColumn("chunk_index", F.col("vec_id").cast("int"))
    return chunking.dedup_near(rows, ["label"], "embedding", 0.4).select("vec_id")


@query("hash_embedding")
def hash_embedding(spark, sf):
    """DuckDB has no sha-512; the tests hold this against a plain version."""
    return read(spark, sf, "documents").select("doc_id", S.hash_embedding(F.col("text"), 64).alias("embedding"))


# profiles


@query("profile_counts", ENTRIES + " SELECT character_name, count(*) AS mention_count, count(*) FILTER (category = 'speech') AS speech_count, count(*) FILTER (category = 'appearance') AS appearance_count, count(*) FILTER (category = 'event') AS event_count, least(3, count(*) FILTER (category = 'speech'))::INT AS kept, character_name || '：在 ' || count(*) || ' 处被提及，对话 ' || count(*) FILTER (category = 'speech') || ' 条、外貌 ' || count(*) FILTER (category = 'appearance') || ' 条、事件 ' || count(*) FILTER (category = 'event') || ' 条。' AS summary FROM entries GROUP BY character_name")
def profile_counts(spark, sf):
    return profile.profiles(entries(spark, sf), 3).select("character_name", "mention_count", "speech_count", "appearance_count", "event_count", F.size("speech").alias("kept"), "summary")


@query(
    "rerank_views",
    FOUND
    + """, v0 AS (SELECT character_name, chunk_index, char_start FROM e),
    v1 AS (SELECT *, (chunk_index * 7 + char_start * 13 + length(character_name) * 31) % 101 AS s1, (chunk_index * 7 + char_start * 13 + 14 * 31) % 101 AS s2 FROM v0),
    v2 AS (SELECT *, row_number() OVER (PARTITION BY character_name ORDER BY s1 DESC, chunk_index, char_start) <= 2 AS t1 FROM v1),
    v3 AS (SELECT *, NOT t1 AND row_number() OVER (PARTITION BY character_name, t1 ORDER BY s2 DESC, chunk_index, char_start) <= 4 AS t2 FROM v2),
    v4 AS (SELECT *, row_number() OVER (PARTITION BY character_name ORDER BY CASE WHEN t1 THEN 0 WHEN t2 THEN 1 ELSE 2 END, CASE WHEN t1 THEN -s1 WHEN t2 THEN -s2 ELSE 0 END, chunk_index, char_start) AS place FROM v3)
    SELECT character_name, chunk_index, char_start, place::INT AS place FROM v4 WHERE place <= 6""",
)
def rerank_views(spark, sf):
    """Six entries a character by three queries; the scores are made up from places, so that SQL has them too."""
    rate = lambda rows: rows.withColumn("score", F.pmod(F.col("chunk_index") * 7 + F.col("char_start") * 13 + F.length("query") * 31, F.lit(101)).cast("double"))
    return profile.rerank_views(entries(spark, sf), 6, rate).select("character_name", "chunk_index", "char_start", "place")


@query("rebuilt_profiles")
def rebuilt_profiles(spark, sf):
    """Every character's texts with other people's names taken out, all at once; the tests hold it against the rule for each."""
    now = save(entries(spark, sf), "entries")
    found = save(profile.profiles(now), "profiles")
    done = profile.rebuilt_all(found, index.characters(now), now)
    return done.select("character_name", *(F.sha2(c, 256).alias(c) for c in ("speech_md", "appearance_md", "events_md", "summary_md")))


@query("anonymize", "SELECT doc_id, sha256(replace(replace(replace(text, 'that', '[人物A]'), 'the', '[人物B]'), '人物', '[友A]')) AS body FROM documents")
def anonymize(spark, sf):
    repls = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("label")) for a, b in (("that", "[人物A]"), ("the", "[人物B]"), ("人物", "[友A]"))))
    return read(spark, sf, "documents").select("doc_id", F.sha2(profile.anonymize(F.col("text"), repls), 256).alias("body"))


@query("labels", "SELECT doc_id, '[' || lang || chr((64 + row_number() OVER (PARTITION BY source, lang ORDER BY doc_id))::INT) || ']' AS label FROM documents")
def labels(spark, sf):
    people = read(spark, sf, "documents").select("doc_id", F.col("source").alias("target"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("relation"), F.col("doc_id").alias("ord"))
    return profile.labels(people).select("doc_id", "label")


@query("co_occurrences", "SELECT source, CASE WHEN count(*) FILTER (lang = 'fr') > 0 THEN count(*) FILTER (lang = 'fr') ELSE sum((length(text) - length(replace(text, 'fr', ''))) / 2) END::INT AS n FROM documents GROUP BY source")
def co_occurrences(spark, sf):
    grouped = read(spark, sf, "documents").groupBy("source").agg(F.collect_list(F.struct("text", F.array("lang").alias("co_mentioned"))).alias("x"))
    return grouped.select("source", profile.co_occurrences(F.lit("fr"), F.col("x")).cast("int").alias("n"))


@query("markdown_block", "SELECT conv_id, sha256('# T' || chr(10) || chr(10) || string_agg('## 条目 ' || n || chr(10) || '> ' || text || chr(10), chr(10) ORDER BY n)) AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def markdown_block(spark, sf):
    texts = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return texts.select("conv_id", F.sha2(profile.block("T", F.col("t")), 256).alias("body"))


# distillation: a signal per document

KIND = "CASE doc_id % 4 WHEN 0 THEN 'values' WHEN 1 THEN 'emotion' WHEN 2 THEN 'taboo' ELSE 'knowledge' END"
SIGNALS = f"s AS (SELECT doc_id, source AS source_file, {KIND} AS category, text AS content, (doc_id % 10) / 10.0::DOUBLE AS salience FROM documents)"


def signal_rows(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.col("source").alias("source_file"), F.expr(KIND).alias("category"), F.col("text").alias("content"), ((F.col("doc_id") % 10) / 10.0).cast("double").alias("salience"), F.lit(1).alias("all"))


@query("condense_rules", f"WITH {SIGNALS}, g AS (SELECT category, content, max(salience) AS m, count(DISTINCT source_file) AS n_sources, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT *, CASE WHEN n_sources >= 2 THEN least(1.0, round(m + 0.1, 6)) ELSE m END AS salience FROM g) SELECT category, content, n_sources, n, salience FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY salience DESC, n DESC, content) AS r FROM l WHERE salience >= 0.35) WHERE r <= 6")
def condense_rules(spark, sf):
    return distill.condense(signal_rows(spark, sf), ["all"]).select("category", "content", "n_sources", "n", "salience")


@query("batch_plan", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source) > 30 THEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 ELSE 0 END AS batch_id FROM documents")
def batch_plan(spark, sf):
    return distill.batches(read(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "batch_id")


@query("failure_gate", "SELECT source, round(avg((quality IS NULL)::INT), 6) AS failure_rate, avg((quality IS NULL)::INT) > 0.5 AS stopped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def failure_gate(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    rate = rows.groupBy("source").agg(distill.failure_rate(F.col("quality").isNull()).alias("r"))
    return rate.select("source", F.round("r", 6).alias("failure_rate"), (F.col("r") > distill.MAX_FAILED).alias("stopped"))


@query("extractor_prompt", "SELECT conv_id, turn, sha256('【来源】' || role || '（第 ' || (turn + 1) || '/' || (count(*) OVER (PARTITION BY conv_id)) || ' 块，字符 0-' || length(text) || '，约 ' || length(text) || ' tokens）' || chr(10) || chr(10) || '【正文】' || chr(10) || text || chr(10) || chr(10) || '请按类别提取人格信号，逐条给出 evidence 与 salience，并写出不超过 120 字的 summary。') AS prompt FROM conversations")
def extractor_prompt(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).withColumn("chunk_index", F.col("turn")).withColumn("char_start", F.lit(0)).withColumn("char_end", F.length("text")).withColumn("token_count", F.length("text"))
    return rows.select("conv_id", "turn", F.sha2(distill.extractor_prompt(F.col("role"), F.col("total")), 256).alias("prompt"))


DISTILLATE = "named_struct('category', role, 'content', text, 'evidence', replace(text, 'e', '3'), 'salience', cast(turn % 10 / 10.0 as double))"


def turn_distillates(spark, sf) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", F.concat("role", F.lit(".txt")).alias("source_file"), F.col("turn").cast("int").alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.array(F.expr(DISTILLATE)).alias("signals"), F.col("text").alias("summary"), F.col("turn").alias("ord"))


@query("bundle", "WITH l AS (SELECT conv_id, role, turn, '- 块#' || turn || ' [0-' || length(text) || '] 速写: ' || text || chr(10) || '    * [' || role || '] salience=' || printf('%.2f', turn % 10 / 10.0) || '  ' || text || '  «' || replace(text, 'e', '3') || '»' AS t FROM conversations), f AS (SELECT conv_id, min(turn) AS o, '### 文件 ' || role || '.txt（' || count(*) || ' 块）' || chr(10) || string_agg(t, chr(10) ORDER BY turn) AS t FROM l GROUP BY conv_id, role) SELECT conv_id, sha256(string_agg(t, chr(10) ORDER BY o)) AS bundle FROM f GROUP BY conv_id")
def bundle(spark, sf):
    return distill.bundle(turn_distillates(spark, sf), ["conv_id"]).select("conv_id", F.sha2("bundle", 256).alias("bundle"))


@query("corpus_digest", "SELECT conv_id, sha256(string_agg('### 分块 ' || n || '（来源: ' || role || '.txt, chunk=' || turn || '）' || chr(10) || '摘要: ' || text || chr(10) || '- [' || role || '] ' || text || '｜证据: ' || replace(text, 'e', '3'), chr(10) ORDER BY n)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def corpus_digest(spark, sf):
    return evaluate.corpus_digest(turn_distillates(spark, sf), ["conv_id"]).select("conv_id", F.sha2("digest", 256).alias("digest"))


# verification: benchmark items as models, turns as evidence


def models(spark, sf) -> DataFrame:
    flag = lambda k: (F.col("item_id") % k != 0)
    v = F.struct(flag(2).alias("cross_domain"), flag(3).alias("generative"), flag(5).alias("exclusive"), F.array(F.lit("own")).alias("cross_domain_evidence"), F.when(flag(7), "x").otherwise(" ").alias("generative_example"), F.lit("y").alias("exclusivity_note"))
    return read(spark, sf, "benchmark").select("item_id", F.lit("Model").alias("name"), F.col("text").alias("principle"), v.alias("verification"))


@query("verification", "WITH k AS (SELECT item_id, regexp_extract_all(text || ' Model', '[A-Za-z]{3,}') AS k FROM benchmark), h AS (SELECT item_id, count(DISTINCT role) AS n FROM k JOIN conversations c ON len(list_filter(k.k, lambda w: contains(c.text, w))) > 0 GROUP BY item_id), z AS (SELECT item_id, item_id % 2 <> 0 OR coalesce(n, 0) >= 2 AS a, item_id % 3 <> 0 AND item_id % 7 <> 0 AS b, item_id % 5 <> 0 AS c FROM k LEFT JOIN h USING (item_id)) SELECT item_id, a AND b AND c AS passed, concat_ws(',', CASE WHEN NOT a THEN 'cross_domain' END, CASE WHEN NOT b THEN 'generative' END, CASE WHEN NOT c THEN 'exclusive' END) AS reasons FROM z")
def verification(spark, sf):
    turns = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("ord"), F.col("role").alias("category"), F.col("text").alias("content"), F.lit("").alias("evidence"))
    return distill.verify(models(spark, sf), turns, "item_id").select("item_id", "passed", F.array_join("reasons", ",").alias("reasons"))


@query("restrict_skills", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END::INT AS kept FROM benchmark")
def restrict_skills(spark, sf):
    own = F.array(F.struct(F.lit("Model").alias("name")), F.struct(F.lit("Other").alias("name")))
    cards = models(spark, sf).select(F.col("item_id").alias("persona_id"), F.when(F.col("item_id") % 3 == 0, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct("name"))).alias("mental_models"))
    skills = cards.select("persona_id", own.alias("mental_models"))
    return distill.restrict_skills(skills, cards).select(F.col("persona_id").alias("item_id"), F.size("mental_models").alias("kept"))


# prompts: one per document, put together from its columns

PROMPT = "concat('preface line\\n## 心智模型\\n- ', source, '：by ', lang, '\\n  - 跨域：in ', lang, '\\n  - 生成力：yes\\n- second\\nTaboos:\\n* ', lang, ' -> stop\\n2. plain\\n[表达DNA]\\n- 高频词：', lang, '，', source, ', x，x\\n- 节奏：slow\\n\\n（诚实边界）\\n- limits: ', lang, '\\n决策启发式：\\n- rule ', lang, '\\n')"


def prompt_cards(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.expr(PROMPT).alias("system_prompt"))


@query("section_split", "SELECT doc_id, unnest(['', '心智模型', 'taboos', '表达dna', '诚实边界', '决策启发式']) AS section, unnest([1, 4, 2, 2, 1, 1])::BIGINT AS n FROM documents")
def section_split(spark, sf):
    return dna.sections(prompt_cards(spark, sf), "doc_id").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("prompt_fields", "SELECT doc_id, source || '=by ' || lang || ';second=' AS models, 'in ' || lang AS evidence, false AS exclusive, lang || '>stop;plain>触发后该人格会硬而短地拒绝' AS patterns, lang || '/' || source || '/x' AS vocabulary, 'slow' AS rhythm, 'limits:' || lang AS boundaries, 'rule ' || lang || ':一般决策场景' AS heuristics FROM documents")
def prompt_fields(spark, sf):
    found = dna.extract(prompt_cards(spark, sf), "doc_id")
    pairs = lambda c, a, s, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(s), x[b])), ";")
    first = F.get("mental_models", F.lit(0))
    return found.select(
        "doc_id", pairs("mental_models", "name", "=", "principle").alias("models"), F.array_join(first["verification"]["cross_domain_evidence"], ",").alias("evidence"), first["verification"]["exclusive"].alias("exclusive"), pairs("anti_patterns", "pattern", ">", "reason").alias("patterns"),
        F.array_join(F.col("expression_dna")["vocabulary"], "/").alias("vocabulary"), F.col("expression_dna")["rhythm"].alias("rhythm"), pairs("honest_boundaries", "limitation", ":", "reason").alias("boundaries"), pairs("decision_heuristics", "rule", ":", "trigger").alias("heuristics"),
    )


# scores: counts derived from the documents

COUNTS = {"vocab_n": "n_chars % 20", "rhythm_present": "doc_id % 2", "tics_n": "n_chars % 7", "metaphors_n": "doc_id % 5", "openings_n": "n_chars % 3", "mm_n": "doc_id % 7", "mm_passed": "doc_id % 7 // 2", "ap_n": "n_chars % 5", "hb_n": "doc_id % 4", "dh_n": "n_chars % 4"}
_CAP = "least({c} / {k}.0::DOUBLE, 1.0) * {w}"
RICH = " + ".join(_CAP.format(c=c, k=cap, w=w) for c, (w, cap) in evaluate.RICHNESS.items())
TOTAL = f"({RICH}) * 0.25 + least(mm_n / 5.0, 1.0) * (CASE WHEN mm_n > 0 THEN mm_passed / mm_n ELSE 0 END) * 0.30 + " + " + ".join(_CAP.format(c=c, k=k, w=w) for c, w, k in (("ap_n", 0.20, 3), ("hb_n", 0.10, 2), ("dh_n", 0.15, 3)))
SCORED = "c AS (SELECT doc_id, n_chars, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in COUNTS.items()) + " FROM documents)"


def scored(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    return evaluate.coverage(docs.select("doc_id", "n_chars", *(F.expr(f"cast({e.replace('//', 'div')} as int)").alias(n) for n, e in COUNTS.items())))


@query("coverage_score", f"WITH {SCORED} SELECT doc_id, round({RICH}, 6) AS richness, round({TOTAL}, 6) AS total_score, vocab_n + rhythm_present + tics_n + metaphors_n + openings_n + mm_n + ap_n + hb_n + dh_n = 0 AS all_empty FROM c")
def coverage_score(spark, sf):
    return scored(spark, sf).select("doc_id", F.round("richness", 6).alias("richness"), F.round("total_score", 6).alias("total_score"), "all_empty")


@query("overall_score", f"WITH {SCORED}, t AS (SELECT doc_id, {TOTAL} AS t, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 - 1.0 END AS f, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 / 2.0 - 1 END AS i, doc_id % 2 = 0 AS ok FROM c) SELECT doc_id, round(CASE WHEN f IS NULL AND i IS NULL THEN t ELSE greatest(0, least(1, t * 0.3 + greatest(f, 0) * 0.4 + (CASE WHEN i < 0 THEN 0 WHEN ok THEN 1 ELSE i * 0.5 END) * 0.3)) END, 6) AS overall FROM t")
def overall_score(spark, sf):
    absent = F.col("doc_id") % 4 == 0
    fidelity, confidence = F.when(~absent, (F.col("doc_id") % 3 - 1).cast("double")), F.when(~absent, F.col("doc_id") % 5 / 2.0 - 1)
    return scored(spark, sf).select("doc_id", F.round(evaluate.overall(F.col("total_score"), fidelity, confidence, F.col("doc_id") % 2 == 0), 6).alias("overall"))


# resumable processing: a source is a corpus, a document a chunk


def _tables(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("source").alias("corpus_uuid"), F.col("doc_id").cast("string").alias("chunk_uuid"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    registry = docs.groupBy("corpus_uuid").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    first = docs.where("doc_id % 3 = 0").select("corpus_uuid", "chunk_uuid", "content_hash", F.lit(1).alias("mention_count"), F.lit("2024").alias("processed_at"))
    again = docs.where("doc_id % 6 = 0").select("corpus_uuid", "chunk_uuid", F.lit("changed").alias("content_hash"), F.lit(2).alias("mention_count"), F.lit("2025").alias("processed_at"))
    return docs, registry, incremental.mark(first, again)


@query("incremental_progress", "SELECT source AS corpus_uuid, count(*) FILTER (doc_id % 3 = 0) AS processed, count(*) AS total FROM documents GROUP BY source")
def incremental_progress(spark, sf):
    _, registry, done = _tables(spark, sf)
    return incremental.progress(registry, done)


@query("incremental_pending", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0")
def incremental_pending(spark, sf):
    docs, _, done = _tables(spark, sf)
    return incremental.pending(docs, done).select("doc_id")


@query("corpus_register", "SELECT DISTINCT source AS corpus_uuid FROM documents WHERE source NOT IN ('src0', 'src1')")
def corpus_register(spark, sf):
    _, registry, _ = _tables(spark, sf)
    return incremental.register(registry.where("corpus_uuid in ('src0', 'src1')"), registry).select("corpus_uuid")
