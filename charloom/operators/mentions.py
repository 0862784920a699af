"""Mention extraction and normalisation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from charloom.functions import ids
from charloom.functions import text as T
from charloom.functions.rescue import fenced_json

CATEGORIES = ("speech", "appearance", "event")
#: Runs of two to four CJK characters are names, but for these words.
NAME_PATTERN = r"[\x{4e00}-\x{9fa5}]{2,4}"
STOP_NAMES = ("我们", "他们", "她们", "这个", "那个")
BEFORE, AFTER = 20, 40
#: Texts of a batch whose names are looked for at a time.
TEXTS = 100
MENTION = "name string, aliases array<string>, category string, evidence string, char_start int, char_end int, co_mentioned array<string>, relation_to string"


def drop_injected(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(~T.injected(F.col(text)))


FOUND = "array<struct<name:string,s:int,e:int,evidence:string>>"


def _locate(pattern: str, stop: tuple[str, ...]):
    """A column function: the matches of a text in one pass from its start, besides the stop words."""
    return F.arrow_udf(_located(pattern, stop), FOUND)


def _located(pattern: str, stop: tuple[str, ...]):
    find = re.compile(re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)).finditer
    skipped = frozenset(stop)

    def part(texts: list) -> pa.Array:
        names, starts, ends, evidence, bounds = [], [], [], [], [0]
        for text in texts:
            for m in find(text or ""):
                if m[0] not in skipped:
                    a, b = m.span()
                    names.append(m[0])
                    starts.append(a)
                    ends.append(b)
                    evidence.append(text[max(0, a - BEFORE) : b + AFTER])
            bounds.append(len(names))
        found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(evidence, pa.string())], names=["name", "s", "e", "evidence"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)

    def located(texts: pa.Array) -> pa.Array:
        # Python's own strings are held for a few texts of a batch at a time
        return pa.concat_arrays([part(texts.slice(k, TEXTS).to_pylist()) for k in range(0, max(1, len(texts)), TEXTS)])

    return located


def heuristic_mentions(chunks: DataFrame, pattern: str = NAME_PATTERN, stop: tuple[str, ...] = STOP_NAMES, detect_injection: bool = True) -> DataFrame:
    """A row per name found in a chunk, with the surrounding text as evidence and offsets within the chunk. Offsets need a
    scan that no built-in function has in linear time, so matches are located in Arrow batches; all else stays in the JVM, and
    the chunk's text goes with the mentions only where it is asked for."""
    rows = drop_injected(chunks) if detect_injection else chunks
    kept = [c for c in rows.columns if c not in ("name", "evidence", "category", "aliases", "co_mentioned", "relation_to", "mention_start", "mention_end")]
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("_m", F.explode(_locate(pattern, stop)(F.col("text"))))
    return rows.select(*kept, F.col("_m.name").alias("name"), F.col("_m.evidence").alias("evidence"), F.lit("event").alias("category"), empty.alias("aliases"), empty.alias("co_mentioned"), F.lit(None).cast("string").alias("relation_to"), F.col("_m.s").alias("mention_start"), F.col("_m.e").alias("mention_end"))


def valid_evidence(mentions: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Mentions whose evidence is found in their chunk's text."""
    body = chunks.select(*key, F.col("text").alias("_text"))
    return mentions.join(body, key).where(T.evidence_valid(F.col("evidence"), F.col("_text"))).drop("_text")


def _text(value) -> str | None:
    """The evidence of an item: a string, or what an object has under evidence or text."""
    if isinstance(value, dict):
        return next((v.strip() for v in (value.get("evidence"), value.get("text")) if isinstance(v, str) and v.strip()), None)
    return (value.strip() or None) if isinstance(value, str) else None


def normalize(data) -> list[dict]:
    """Mentions from a model's reply in any of its forms: a category (or type) with evidence, lists under the categories, or
    evidence alone, which is an event."""
    raw = data.get("mentions", []) if isinstance(data, dict) else []
    out: list[dict] = []
    for item in raw if isinstance(raw, list) else []:
        if not isinstance(item, dict) or not (name := str(item.get("name", "")).strip()):
            continue
        aliases, others, relation = item.get("aliases", []), item.get("co_mentioned", []), item.get("relation_to")
        aliases = [aliases] if isinstance(aliases, str) else [str(a) for a in aliases if a] if isinstance(aliases, list) else []
        others = ([others] if others.strip() else []) if isinstance(others, str) else [s for o in others if (s := str(o).strip())] if isinstance(others, list) else []
        relation = str(relation).strip() if relation else None
        same = {"name": name, "aliases": aliases, "char_start": 0, "char_end": 0, "co_mentioned": others, "relation_to": None if relation in ("", "null", "None") else relation}
        kind, evidence = item.get("category") or item.get("type"), item.get("evidence")
        if kind in CATEGORIES and evidence is not None:
            out.append(same | {"category": kind, "evidence": str(evidence)})
            continue
        nested = []
        for c in CATEGORIES:
            parts = item.get(c)
            for part in parts if isinstance(parts, list) else [] if parts is None else [parts]:
                if found := _text(part):
                    nested.append(same | {"category": c, "evidence": found})
        if not nested and evidence is not None and kind is None:
            nested = [same | {"category": "event", "evidence": str(evidence)}]
        out += nested
    return out


def normalize_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Explodes the mentions of JSON replies; replies that aren't JSON objects have none."""
    keys = [c for c in replies.columns if c != column]
    schema = StructType([*(replies.schema[k] for k in keys), *StructType.fromDDL(f"mentions array<struct<{MENTION.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int')}>>").fields])
    fields, at = to_arrow_schema(schema), replies.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for reply in batch.column(at).to_pylist():
                body = fenced_json(reply or "")
                try:
                    found.append(normalize(json.loads(body)) if body else [])
                except ValueError:
                    found.append([])
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(found, type=fields.field("mentions").type)], schema=fields)

    return replies.mapInArrow(run, schema).select(*keys, F.inline("mentions"))


def extract_mentions(chunks: DataFrame, ask: Callable[[str], str], prompt: Callable[[str], str]) -> DataFrame:
    """One call of the model per chunk that isn't injected; a failed call or reply has no mentions; evidence is checked.
    ask() runs in the tasks and must be safe to repeat, since a task may be run again."""
    keys = [c for c in chunks.columns]
    kept = drop_injected(chunks)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("reply string").fields])
    fields, at = to_arrow_schema(schema), kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for body in batch.column(at).to_pylist():
                try:
                    replies.append(ask(prompt(body)))
                except Exception:
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], schema=fields)

    # the chunk's own offsets make way for the mention's
    renamed = kept.mapInArrow(run, schema).withColumnsRenamed({"char_start": "chunk_start", "char_end": "chunk_end"})
    found = normalize_replies(renamed)
    return found.where(T.evidence_valid(F.col("evidence"), F.col("text")))


ENTRY = "uuid string, character_name string, aliases array<string>, category string, text string, source string, corpus_uuid string, char_start int, char_end int, chunk_index int, relation_to string, co_mentioned array<string>"


def to_entries(mentions: DataFrame, deterministic: bool = True) -> DataFrame:
    """Index entries from mentions with their chunk's source, corpus_uuid, chunk_index and chunk_start: offsets become the
    document's. The id comes from the content, so a second ingest meets its own rows; deterministic=False gives random ones."""
    start = F.coalesce(F.col("chunk_start"), F.lit(0))
    own = ids.uuid5(F.concat_ws("\0", "corpus_uuid", "source", "chunk_index", "category", "name", "mention_start", "evidence"))
    return mentions.select(
        (own if deterministic else F.uuid()).alias("uuid"),
        F.col("name").alias("character_name"), "aliases", "category", F.col("evidence").alias("text"), "source", "corpus_uuid",
        (start + F.col("mention_start")).cast("int").alias("char_start"), (start + F.col("mention_end")).cast("int").alias("char_end"), F.col("chunk_index").cast("int").alias("chunk_index"), "relation_to", "co_mentioned",
    )


def ingest_batch(spark, payload: str) -> DataFrame:
    """Entries from one batch reply: an object with items, or a bare list, each with chunk_meta and mentions. Numbers are read
    leniently; items and mentions that make no sense are skipped."""
    try:
        data = json.loads(payload)
    except ValueError as e:
        raise ValueError(f"the batch is not JSON: {e}") from e
    items = data.get("items", []) if isinstance(data, dict) else data if isinstance(data, list) else []

    def number(v) -> int:
        return int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", str(v)) else 0

    rows = []
    for item in items:
        if not isinstance(item, dict):
            continue
        meta = item.get("chunk_meta") if isinstance(item.get("chunk_meta"), dict) else {}
        for m in normalize(item):
            rows.append((m["name"], m["aliases"], m["category"], m["evidence"], str(meta.get("source", "")), str(meta.get("corpus_uuid", "")), number(meta.get("chunk_index", 0)), number(meta.get("char_start", 0)), m["char_start"], m["char_end"], m["relation_to"], m["co_mentioned"]))
    columns = "name string, aliases array<string>, category string, evidence string, source string, corpus_uuid string, chunk_index int, chunk_start int, mention_start int, mention_end int, relation_to string, co_mentioned array<string>"
    return to_entries(spark.createDataFrame(rows, columns))
