"""The character index on disk: entries in buckets by character, with signatures of their trigrams, and their vectors in cells.

A version is a manifest that names a folder for each bucket and cell. A write makes new folders for the buckets it touches, then the
next manifest; so bytes written follow the change, a reader has one version throughout, and a write that dies leaves no trace
in any version. Two writers of one version can't both win. Folders that neither of the last two versions names are deleted.

A signature has a bit for each trigram of an entry's text and name, 256 bits in all, and is written with the entry; so it costs a
write what the entry costs, not a row for each trigram. Text search reads the signatures, then the entries of the buckets where
one has all bits of what it looks for, and decides by the text itself. Vector search goes to the cells whose centres are nearest, or, as an exact search, to all of them.
Centres are fitted on at most SAMPLE vectors, by hash; every vector has a cell.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from charloom.functions.shared import delete, drop, save
from charloom.functions.similarity import cosine

from .mentions import ENTRY

SAMPLE, CENTRES, STEPS = 10_000, 64, 8
#: Columns of a signature, of 64 bits each, and entries that are signed at a time.
SIGNS = tuple(f"_s{k}" for k in range(4))
SIGNED = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class ConcurrentWrite(RuntimeError):
    """Another writer has made this version meanwhile; the write can be tried again."""


def literals(query: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards that have trigrams, with ASCII letters in lower case."""
    return [p for p in re.split("[%_]", query.translate(str.maketrans(UPPER, LOWER))) if len(p) >= 3]


SMALL = np.arange(256, dtype=np.uint32)
SMALL[ord("A") : ord("Z") + 1] += 32


def _bits(data: np.ndarray) -> np.ndarray:
    """The bit of the trigram that starts at each byte but the last two, ASCII letters in lower case."""
    x = SMALL[data]
    return (((x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)


def signatures(texts: list[pa.Array]) -> np.ndarray:
    """A row of signed 64-bit numbers for each row of the columns: the bits of all trigrams, of UTF-8 bytes, in any of them."""
    flags = np.zeros((len(texts[0]), 64 * len(SIGNS)), bool)
    for column in texts:
        column = pc.cast(pc.fill_null(column, ""), pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        if len(data) >= 3:
            row = np.repeat(np.arange(len(column)), np.diff(ends))
            whole = row[:-2] == row[2:]
            flags[row[:-2][whole], _bits(data)[whole]] = True
    return np.packbits(flags, axis=1, bitorder="little").view("<i8")


def signed(rows: DataFrame) -> DataFrame:
    """Adds the signatures of text and name."""
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in SIGNS)])
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED):
                part = batch.slice(at, SIGNED)
                found = signatures([part["text"], part["character_name"]])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(SIGNS)))], schema=fields)

    return rows.mapInArrow(run, schema)


def may_hold(parts: list[str]) -> Column:
    """Whether a signature has all bits of the parts; entries without one may hold anything."""
    wanted = np.bitwise_or.reduce(signatures([pa.array(parts)]), axis=0)
    out = F.lit(True)
    for c, bits in zip(SIGNS, wanted.tolist()):
        out = out & F.coalesce(F.col(c).bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long"), F.lit(True))
    return out


def fit_centres(vectors: DataFrame, column: str = "vector", most: int = CENTRES) -> list[list[float]]:
    """Centres of unit vectors by a few steps of k-means on a sample; as many as the root of the sample's size, up to `most`."""
    rows = [r[0] for r in vectors.select(column).orderBy(F.xxhash64(column)).limit(SAMPLE).collect()]
    if not rows:
        return []
    width = max(map(len, rows))
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    k = max(1, min(most, int(np.sqrt(len(x)))))
    centres = x[:: max(1, len(x) // k)][:k]
    for _ in range(STEPS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres.tolist()


def _nearest(vector, centres: np.ndarray) -> np.ndarray:
    """Cells by how near their centres are, nearest first; a vector of another length is taken as far as it goes."""
    v = np.asarray(vector, float)
    n = min(len(v), centres.shape[1])
    return np.argsort(-(centres[:, :n] @ v[:n]), kind="stable")


def in_cells(vectors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds `cell`, the number of the nearest centre."""
    at = np.array(centres)

    def run(batches):
        for batch in batches:
            cells = [int(_nearest(v, at)[0]) for v in batch["vector"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", cell int")


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.buckets, self.embed = spark, folder.rstrip("/"), buckets, embed

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest version: for each kind of table, a folder for each bucket or cell that has rows."""
        found = [n for n in self._names("versions") if n.endswith(".json")]
        if not found:
            return {"version": 0, "buckets": self.buckets, "entries": {}, "vectors": {}, "centres": []}
        stream = self._fs().open(self._path("versions", found[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, before: dict) -> None:
        fs, name = self._fs(), f"{manifest['version']:010d}.json"
        draft = self._path("drafts", uuid.uuid4().hex)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(self._path("versions"))
        if fs.exists(self._path("versions", name)) or not fs.rename(draft, self._path("versions", name)):
            raise ConcurrentWrite(name)
        for old in self._names("versions")[:-2]:
            fs.delete(self._path("versions", old), False)
        for kind in ("entries", "grams", "vectors"):
            # grams: what an index of an older form has
            kept = {*manifest.get(kind, {}).values(), *before.get(kind, {}).values()}
            for name in set(self._names(kind)) - kept:
                # what a write under way has made isn't named yet, but is younger than the version it began with
                if name.split("-")[0] <= f"{before['version']:010d}":
                    delete(self.spark, f"{self.folder}/{kind}/{name}")

    def _read(self, kind: str, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        key = "cell" if kind == "vectors" else "bucket"
        folders: dict[str, list[str]] = {}
        for b, name in manifest[kind].items():
            if only is None or int(b) in only:
                folders.setdefault(name, []).append(f"{self.folder}/{kind}/{name}/{key}={b}")
        out = None
        for name, paths in sorted(folders.items()):
            part = self.spark.read.option("basePath", f"{self.folder}/{kind}/{name}").option("mergeSchema", True).parquet(*paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _write(self, kind: str, rows: DataFrame, manifest: dict, touched: set[int]) -> dict:
        """New folders for the touched buckets; returns the kind's part of the next manifest."""
        key = "cell" if kind == "vectors" else "bucket"
        name = f"{manifest['version'] + 1:010d}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(key)
        if kind == "entries":
            writer = writer.option("parquet.bloom.filter.enabled#uuid", "true")
        writer.parquet(f"{self.folder}/{kind}/{name}")
        made = {n.split("=")[1] for n in self._names(kind, name) if n.startswith(f"{key}=")}
        return {b: f for b, f in manifest[kind].items() if int(b) not in touched} | dict.fromkeys(made, name)

    # entries

    def _bucket(self, name: str | Column, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def _whole(self, found: DataFrame | None) -> DataFrame:
        """With all columns; tables of an older form lack some."""
        if found is None:
            return self.spark.createDataFrame([], ENTRY)
        for field in self.spark.createDataFrame([], ENTRY).schema:
            if field.name not in found.columns:
                found = found.withColumn(field.name, F.lit(None).cast(field.dataType))
        return found.drop("bucket", *SIGNS)

    def entries(self, name: str | None = None) -> DataFrame:
        """All entries of the newest version; of one character, from its bucket alone."""
        now = self.manifest()
        if name is None:
            return self._whole(self._read("entries", now))
        at = self.spark.range(1).select(self._bucket(F.lit(name), now["buckets"])).first()[0]
        return self._whole(self._read("entries", now, [at])).where(F.col("character_name") == name)

    def _touched(self, now: dict, gone: DataFrame, keys: list[str]) -> set[int]:
        """Buckets with entries that `gone` names; only the key columns are read."""
        every = self._read("entries", now)
        if every is None:
            return set()
        return {r.bucket for r in every.select(*keys, "bucket").join(gone.select(*keys).distinct(), keys, "left_semi").select("bucket").distinct().collect()}

    def _replace(self, now: dict, rows: DataFrame, touched: set[int], gone: DataFrame, new: DataFrame | None) -> None:
        """The next version: `rows` are all entries of the touched buckets; the vectors of `gone` uuids go, those of `new` come."""
        placed = signed(rows).withColumn("bucket", self._bucket("character_name", now["buckets"]))
        after = {k: v for k, v in now.items() if k != "grams"} | {"version": now["version"] + 1}
        after["entries"] = self._write("entries", placed.hint("rebalance", "bucket"), now, touched)
        if self.embed:
            after = self._with_vectors(now, after, gone, new)
        self._commit(after, now)

    def add(self, new: DataFrame) -> None:
        """Adds entries; one whose uuid is there takes its place. Of new ones with one uuid one stays."""
        now = self.manifest()
        new = save(new, "new")
        if not new.groupBy("uuid").count().where("count > 1").isEmpty():
            once = save(new.dropDuplicates(["uuid"]), "new")
            drop(new)
            new = once
        own = {r[0] for r in new.select(self._bucket("character_name", now["buckets"])).distinct().collect()}
        touched = own | self._touched(now, new, ["uuid"])
        if touched:
            kept = self._whole(self._read("entries", now, list(touched)))
            rows = kept.join(new.select("uuid"), "uuid", "left_anti").unionByName(new, allowMissingColumns=True)
            self._replace(now, rows, touched, new.select("uuid"), new)
        drop(new)

    def write(self, entries: DataFrame) -> None:
        """Takes the place of all entries."""
        now, held = self.manifest(), save(entries, "all")
        self._replace(now, held, set(range(now["buckets"])), self.entries().select("uuid"), held)
        drop(held)

    def merge_all(self, pairs: DataFrame) -> int:
        """Renames sources to targets, (source, target); how many entries moved."""
        from .index import merge

        now = self.manifest()
        pairs = save(pairs.where("source != target and source != '' and target != ''"), "pairs")
        at = [self._bucket(c, now["buckets"]) for c in ("source", "target")]
        touched = {b for r in pairs.select(*at).distinct().collect() for b in r}
        rows = self._whole(self._read("entries", now, list(touched)))
        moved = rows.join(pairs.select(F.col("source").alias("character_name")), "character_name", "left_semi").count()
        if moved:
            self._replace(now, merge(rows, pairs), touched, rows.limit(0).select("uuid"), None)
        drop(pairs)
        return moved

    def merge(self, source: str, target: str) -> int:
        return self.merge_all(self.spark.createDataFrame([(source, target)], "source string, target string"))

    def delete_chunk(self, chunks: DataFrame) -> int:
        """Deletes the entries of chunks given by corpus_uuid, source and chunk_index; how many."""
        keys, now = ["corpus_uuid", "source", "chunk_index"], self.manifest()
        chunks = save(chunks.select(*keys).distinct(), "chunks")
        touched = self._touched(now, chunks, keys)
        rows = self._whole(self._read("entries", now, list(touched)))
        gone = save(rows.join(chunks, keys, "left_semi").select("uuid"), "gone")
        n = gone.count()
        if n:
            self._replace(now, rows.join(chunks, keys, "left_anti").select(*rows.columns), touched, gone, None)
        drop(chunks)
        drop(gone)
        return n

    def count(self) -> int:
        return self.entries().count()

    def clear(self) -> None:
        delete(self.spark, self.folder)

    # searches

    def search_text(self, query: str, name: str | None = None, k: int = 10) -> DataFrame:
        """As index.search_text() over all entries. A query without three characters in a row reads all of them."""
        from .index import search_text

        now = self.manifest()
        parts, every = literals(query), self._read("entries", now)
        if not parts or every is None or SIGNS[0] not in every.columns:
            return search_text(self._whole(every), query, name, k)
        buckets = [r.bucket for r in every.where(may_hold(parts)).select("bucket").distinct().collect()]
        found = self._read("entries", now, buckets).where(may_hold(parts)) if buckets else None
        return search_text(self._whole(found), query, name, k)

    def _with_vectors(self, now: dict, after: dict, gone: DataFrame, new: DataFrame | None) -> dict:
        add = None
        if new is not None:
            embedded = self.embed(new.select("uuid", "text")).select("uuid", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
            norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
            add = save(embedded.where((norm > 0) & (norm < float("inf"))).select("uuid", F.transform("v", lambda x: x / norm).alias("vector")), "vectors")
            if not now["centres"]:
                after["centres"] = fit_centres(add)
        if not after["centres"]:
            return after
        held = self._read("vectors", now)
        touched = set() if held is None else {r.cell for r in held.select("uuid", "cell").join(gone, "uuid", "left_semi").select("cell").distinct().collect()}
        rows = None
        if add is not None:
            rows = save(in_cells(add, after["centres"]), "cells")
            touched |= {r.cell for r in rows.select("cell").distinct().collect()}
        if touched:
            kept = self._read("vectors", now, list(touched))
            if kept is not None:
                kept = kept.join(gone, "uuid", "left_anti").select("uuid", "vector", "cell")
                rows = kept if rows is None else kept.unionByName(rows)
            after["vectors"] = self._write("vectors", rows.hint("rebalance", "cell"), now, touched)
        return after

    def recover_vectors(self) -> int:
        """Fits the centres anew and works out all vectors from the entries; how many there are."""
        now = self.manifest()
        after = dict(now, version=now["version"] + 1, vectors={}, centres=[])
        every = self.entries()
        after = self._with_vectors(after | {"version": now["version"]}, after, every.limit(0).select("uuid"), every)
        self._commit(after, now)
        found = self._read("vectors", after)
        return 0 if found is None else found.count()

    def _intact(self, now: dict) -> bool:
        fs = self._fs()
        return all(fs.exists(self._path("vectors", name, f"cell={c}")) for c, name in now["vectors"].items())

    def search_vector(self, vector: list[float], name: str | None = None, k: int = 10, probes: int | None = None) -> DataFrame:
        """The k entries with the greatest cosine, ties by uuid: exact, or among the `probes` nearest cells. Lost vectors are worked
        out again from the entries first."""
        now = self.manifest()
        if now["entries"] and self.embed and (not now["vectors"] or not self._intact(now)):
            self.recover_vectors()
            now = self.manifest()
        cells = None if probes is None or not now["centres"] else _nearest(vector, np.array(now["centres"]))[:probes].tolist()
        found = self._read("vectors", now, cells)
        every = self._whole(self._read("entries", now))
        if found is None:
            return every.limit(0).withColumn("score", F.lit(0.0))
        if name:
            found = found.join(self.entries(name).select("uuid"), "uuid", "left_semi")
        best = found.select("uuid", cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector))).alias("score")).orderBy(F.desc("score"), "uuid").limit(k)
        # k rows; the files' Bloom filters tell which ones hold them
        ids = [(r.uuid, r.score) for r in best.collect()]
        scored = self.spark.createDataFrame(ids, "uuid string, score double")
        return every.where(F.col("uuid").isin([i for i, _ in ids])).join(F.broadcast(scored), "uuid").orderBy(F.desc("score"), "uuid")
