"""Files to documents.

Spark lists and reads the files (binaryFile), so any store it knows works and files are decoded in parallel; what a file says is
made text by a loader per suffix. A loader takes the decoded text and returns the document's text; register more in LOADERS.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charloom.operators.chunking import identify

DEFAULT_MAX_MB = 100.0
#: The keys that hold an object's text, in order.
JSON_KEYS = ("text", "content", "body", "dialogue", "message")
JSONL_KEYS = ("text", "content", "body", "message", "utterance")


def decode(raw: bytes) -> str:
    """By byte order mark; else strict UTF-8, strict UTF-16, and GB18030 with replacement."""
    if raw.startswith(codecs.BOM_UTF8):
        return raw[3:].decode("utf-8", "replace")
    if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return raw[2:].decode("utf-16-le" if raw.startswith(codecs.BOM_UTF16_LE) else "utf-16-be", "replace")
    for encoding in ("utf-8", "utf-16"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("gb18030", "replace")


def _of_object(value: dict, keys: tuple[str, ...]) -> str:
    return next((value[k] for k in keys if isinstance(value.get(k), str)), None) or _dump(value, keys)


def _dump(value: dict, keys: tuple[str, ...]) -> str:
    return "" if any(isinstance(value.get(k), str) for k in keys) else json.dumps(value, ensure_ascii=False)


def plain_text(text: str) -> str:
    return text


def json_text(text: str) -> str:
    def flat(value) -> str:
        if isinstance(value, dict):
            return _of_object(value, JSON_KEYS)
        if isinstance(value, list):
            return "\n".join(map(flat, value))
        return value if isinstance(value, str) else str(value)

    return flat(json.loads(text))


def jsonl_text(text: str) -> str:
    """Objects and strings give their text, broken lines stay as they are, other values are left out."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        try:
            value = json.loads(line)
        except ValueError:
            out.append(line)
            continue
        if isinstance(value, dict):
            out.append(_of_object(value, JSONL_KEYS))
        elif isinstance(value, str):
            out.append(value)
    return "\n".join(out)


def delimited_text(delimiter: str) -> Callable[[str], str]:
    return lambda text: "\n".join(delimiter.join(row) for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


LOADERS: dict[str, Callable[[str], str]] = {
    **dict.fromkeys((".txt", ".md", ".markdown", ".rst", ".log", ".yaml", ".yml"), plain_text),
    ".json": json_text,
    ".jsonl": jsonl_text,
    ".csv": delimited_text(","),
    ".tsv": delimited_text("\t"),
}


def resolve_path(path: str, workdir: str = ".") -> str:
    """The path as given, from the current folder, or from the work folder, whichever exists."""
    tried = [path, os.path.join(os.getcwd(), path), os.path.join(workdir, path)]
    for p in tried:
        if os.path.exists(p):
            return os.path.abspath(p)
    raise FileNotFoundError(f"none of these exists: {', '.join(tried)}")


def load_corpus(spark: SparkSession, path: str, max_mb: float = DEFAULT_MAX_MB) -> DataFrame:
    """A row per file: path, relpath, ext, text, content_hash, corpus_uuid, size_chars. A folder is read with all below it, as
    far as there are loaders; a single file is read in any case, as plain text if need be. Ordered by the parts of the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    single = fs.getFileStatus(hadoop).isFile()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    files = files.withColumn("ext", ext)
    if not single:
        files = files.where(F.col("ext").isin(*LOADERS))
    sizes = files.select("path", "length")
    if sizes.isEmpty():
        raise ValueError(f"nothing to load under {path}")
    if max_mb > 0 and (big := sizes.where(F.col("length") > max_mb * 1024 * 1024).first()):
        raise ValueError(f"{big.path} has {big.length} bytes; the limit is {max_mb} MiB")
    base = hadoop.getParent() if single else hadoop
    root = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    loaders = dict(LOADERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            texts = [loaders.get(k, plain_text)(decode(raw)) for k, raw in zip(kinds, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "ext", "text"])

    docs = files.select("path", "ext", "content").mapInArrow(run, "path string, ext string, text string")
    plain = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    docs = docs.withColumn("relpath", F.when(F.startswith(plain, F.lit(root)), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain))
    return identify(docs).orderBy(F.split("relpath", "/"))


def display_name(relpath):
    """The file's name without its suffix."""
    return F.regexp_replace(F.element_at(F.split(relpath, "/"), -1), r"(?<=.)\.[^.]*$", "")
