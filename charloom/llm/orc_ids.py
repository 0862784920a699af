"""Token ids as ORC files: integer run-length encoded lists, row indexes and a Bloom filter on the document ids.

Documents are dealt into ranges of doc_id and sorted before they are encoded, so the files hold them in ascending order and
stripes can be pruned by their statistics and Bloom filters (`lookup`). A document's place within its file is stored with it.
A null text is empty and holds the end id only. Equal doc_ids stay side by side in the order of their texts, each a row of its
own; a null doc_id comes first. An empty table gives files without rows. Only the two columns are read, whatever others are
called. Special tokens of the tokenizer in a text are what the library makes of them: their own ids.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, save, shared_dir, table, texts, trim

#: Words whose ids a worker keeps in each of two generations; those in use pass from the older to the newer.
MEMO = 600_000
TAIL = string.punctuation.encode()
#: Fixed value: how the tokenizer cuts a word of ASCII characters.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Bytes of input for a file, so the number of files follows the input.
FILE_BYTES = 32 << 20
GROUP_BYTES, JOINED = 10_000_000, 300


def _ends_word(core: bytes) -> bool:
    """Whether the last character is a letter or number and stays one in small letters."""
    if core[-1] < 128:
        return core[-1:].isalnum()
    last = core.decode("utf-8", "replace")[-1]
    return last.isalnum() and len(last.lower()) == 1


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases: ASCII white space always ends its words, a
    word of ASCII characters is cut as the tokenizer would, and of other words a run of ASCII punctuation at the end, after a
    letter or number, is a word of its own; so these parts' ids are kept and joined. A text with a special token in it goes to
    the tokenizer whole. Ids are held as the bytes of little-endian 32-bit integers."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # a word in small letters is never a special token
        pieces = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.last = np.array([(p or "").endswith("</w>") for p in pieces])
        self.now: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}

    def _ask(self, words: list[bytes]) -> None:
        texts_ = [w.decode("utf-8", "replace") for w in words]
        alone = []
        plain = [i for i, t in enumerate(texts_) if t.isalpha()]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join([texts_[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found):
            # each word of letters ends in its own last piece; if the counts differ, they are asked one by one
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):
                alone += group
                continue
            raw, start = ids.tobytes(), 0
            for i, end in zip(group, (4 * ends).tolist()):
                self.now[words[i]] = raw[start:end]
                start = end
        alone += [i for i, t in enumerate(texts_) if not t.isalpha()]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts_[i] for i in alone], add_special_tokens=False)):
            self.now[words[i]] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Puts the words into the newer generation."""
        now, before = self.now, self.before
        asked, split = set(), []
        for w in words:
            if w in before:
                now[w] = before[w]
            elif w.isalpha():  # ASCII letters
                asked.add(w)
            else:
                if w.isascii():
                    parts = PIECES.findall(w)
                elif len(core := w.rstrip(TAIL)) < len(w) and core and _ends_word(core):
                    parts = [core, w[len(core) :]]
                else:
                    parts = [w]
                if len(parts) == 1:
                    asked.add(w)
                    continue
                split.append((w, parts))
                for part in parts:
                    if part not in now:
                        if (known := before.get(part)) is not None:
                            now[part] = known
                        else:
                            asked.add(part)
        self._ask(list(asked))
        for w, parts in split:
            now[w] = b"".join([now[x] for x in parts])

    def __call__(self, group: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, where each text's begin and the last one's end). Arrow cuts the words and
        numbers them, so each distinct word of the group is looked up once; those not known yet are asked for at once."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(group))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.now) > MEMO:
            self.before, self.now = self.now, {b"": b""}
        known = list(map(self.now.get, words))
        if new := [i for i, k in enumerate(known) if k is None]:
            self._learn([words[i] for i in new])
            for i in new:
                known[i] = self.now[words[i]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        held, starts = np.frombuffer(b"".join(known), "<i4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at]
        ends = np.cumsum(each)
        # where each id is in held: the word's start, and one on for each of its ids
        from_ = np.repeat((starts[at] - ends + each).astype(np.int32), each)
        from_ += np.arange(len(from_), dtype=np.int32)
        ids = held[from_]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = np.concatenate([[0], ends])[bounds]
        if own := [i for s in self.special for i in np.flatnonzero(pc.match_substring(group, s).to_numpy(zero_copy_only=False)).tolist()]:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in own:
                parts[i] = np.array(self.whole.encode(group[i].as_py(), add_special_tokens=False).ids, "<i4")
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


_encoder: tuple[int, WordIds] | None = None


def encoder(spec: str) -> WordIds:
    """The encoder of a tokenizer, kept by the worker from task to task: parsing it and learning the words anew would cost
    each task a second. Only the last one is kept, so a worker holds two generations of words at most."""
    global _encoder
    key = zlib.crc32(spec.encode())
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, WordIds(spec))
    return _encoder[1]


def _groups(texts_: pa.StringArray) -> Iterator[pa.StringArray]:
    """Slices of GROUP_BYTES or a little more, so that few of them hold a word twice; a longer text is in one with those before."""
    ends = np.cumsum(pc.binary_length(texts_).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts_):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES)) + 1
        yield texts_.slice(at, to - at)
        at = to


ROW = "doc_id long, inside long, ids array<int>"


def _size(rows: DataFrame) -> int:
    """Bytes of the input, as the planner knows them of files; of other sources, characters of the texts."""
    known = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else rows.agg(F.sum(F.length("text")).alias("n")).collect()[0]["n"] or 0


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, parts: int | None = None, stripe: int = 16 << 20) -> str:
    """Writes (doc_id, inside, ids) in ascending doc_id order under path and returns it. inside: the ids of the documents
    before it in its file."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encode, inside = encoder(spec.value), 0
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                part = batch.slice(at, len(group))
                at += len(group)
                ids, bounds = encode(group)
                ids = np.insert(ids, bounds[1:], end_id)
                offsets = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(inside + offsets[:-1]), lists], names=["doc_id", "inside", "ids"])
                inside += int(offsets[-1])
        trim()

    rows = texts(docs)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_size(rows) // FILE_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    written = dealt.mapInArrow(run, ROW).write.option("compression", "lz4").option("orc.create.index", "true").option("orc.row.index.stride", "1000")
    written.option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", str(stripe)).orc(path)
    return path


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, inside, ids) of the documents asked for. The filter reaches the files, where the statistics and Bloom filters of
    stripes and row groups tell which of them are read."""
    return spark.read.schema(ROW).orc(path).where(F.col("doc_id").isin(doc_ids))


def _open(file: str):
    """An ORC file in any store that pyarrow knows."""
    from pyarrow import fs, orc

    store, at = fs.FileSystem.from_uri(file)
    return orc.ORCFile(store.open_input_file(at))


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """(file, stripe) of all stripes, from the files' footers, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(f, i) for f in batch.column(0).to_pylist() for i in range(_open(f).nstripes)]
            yield pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in found], pa.string()), "stripe": pa.array([i for _, i in found], pa.int32())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.createDataFrame([(f,) for f in spark.read.schema(ROW).orc(path).inputFiles()], "file string")
    return files.repartition(n, "file").mapInArrow(run, "file string, stripe int").repartition(n, "file", "stripe")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files stripe by stripe: its start among all ids, the number of its ids and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for file, stripe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = _open(file).read_stripe(stripe)
                lists = rows.column(2)
                values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
                raw = memoryview(np.ascontiguousarray(values)).cast("B")
                cut = (4 * at.astype(np.int64)).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64()), pa.array([file] * len(crcs), pa.string())], names=["doc_id", "inside", "n_tokens", "ids_crc32", "file"])
        trim()

    rows = save(stripes(spark, path).mapInArrow(run, "doc_id long, inside long, n_tokens long, ids_crc32 long, file string"), "orc-rows")
    # one row per file, so one task orders them
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("final"), F.sum("n_tokens").alias("size"))
    before = Window.orderBy("first", "final", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    at = f"{shared_dir(spark)}/orc-{uuid.uuid4().hex}"
    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), at))
