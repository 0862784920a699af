"""WARC records in ZIP packages: written per task, then read back by their directories.

A package is a ZIP file of two stored members: archive/data.warc.gz (each record a gzip member of its own) and
indexes/index.cdx (a line per record: id, offset, length). The reader parses the end-of-directory record, ZIP64 ones included,
finds the stored members in the central directory and range-reads records in place; nothing is unpacked to disk.

A null html is an empty payload. Repeated page_ids stay records of their own: each row gets a record, and rows of one page_id
with different payloads are told apart by digest. Of equal rows with a large payload one is the response. A null page_id is
smaller than any other; large payloads that null ids alone have are all responses. An empty table gives no package. Other
columns are ignored. Packages live in the shared folder under names no other attempt uses, and only those that a finished task
names are read, so a lost executor leaves unread files at worst.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, map_rows, save, shared_dir, table, trim

#: Payloads shorter than this are never revisits.
LEAST = 1000
#: Bytes of a package, from which a task goes on in another one.
PACKAGE_BYTES = 1 << 30
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of the file's end in which the end-of-directory record lies: its 22 bytes and the longest comment.
TAIL = 22 + 65535 + 20
LIMIT_16, LIMIT_32 = 0xFFFF, 0xFFFFFFFF


class PackageWriter:
    """Streams a ZIP of stored members, with ZIP64 fields for all sizes."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = {"name": raw, "header": self.at, "size": 0, "crc": 0}
        # sizes and checksum follow the data (bit 3), as 64-bit numbers since a ZIP64 field is there
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, LIMIT_32, LIMIT_32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Returns the offset of data in the open member."""
        m = self.open
        offset = m["size"]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), offset + len(data)
        self._put(data)
        return offset

    def end(self) -> None:
        m = self.open
        self._put(struct.pack("<IIQQ", 0x08074B50, m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], LIMIT_32, LIMIT_32, len(m["name"]), 28, 0, 0, 0, 0, LIMIT_32) + m["name"] + struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"]))
        size, n, at = self.at - start, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, LIMIT_16, LIMIT_16, LIMIT_32, LIMIT_32, 0))


def directory(read_at: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of all stored members; compressed ones are refused."""
    tail_at = max(0, size - TAIL)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end-of-directory record")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if LIMIT_16 == n or LIMIT_32 in (length, start):
        where = tail.rfind(b"PK\x06\x07", 0, end)
        if where < 0:
            raise ValueError("no ZIP64 locator")
        far = read_at(struct.unpack_from("<Q", tail, where + 8)[0], 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end-of-directory record")
        n, length, start = struct.unpack_from("<QQQ", far, 32)
    listing, at, out = read_at(start, length), 0, {}
    for _ in range(n):
        if listing[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", listing, at + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", listing, at + 20)
        header, = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = listing[at + 46 + n_name : at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                plain = next(values) if plain == LIMIT_32 else plain
                packed = next(values) if packed == LIMIT_32 else packed
                header = next(values) if header == LIMIT_32 else header
            k += 4 + width
        at += 46 + n_name + n_extra + n_note
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read in place")
        own = read_at(header, 30)
        out[name] = (header + 30 + sum(struct.unpack_from("<HH", own, 26)), packed)
    return out


def record(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(payload)))])
    return head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is longer or shorter than it says")
    return fields, rest[:n]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _store(uri: str):
    """Any store that pyarrow knows, by the shared folder's address; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def clean_url(url: str) -> str:
    return "".join(c for c in url if c.isprintable() and c != " ")


def record_id(page_id, digest: str, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{extra}')}>"


def revisits_of(rows: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, once) of the payloads of LEAST bytes or more that others equal; rows: page_id, digest, n.
    Where `once` is true, several equal rows have the largest page_id, and all but one of them revisit it."""
    # by row first, so a hot payload is one row per page_id and task
    keys = rows.where(F.col("n") >= LEAST).groupBy("digest", "n", "page_id").agg(F.count(F.lit(1)).alias("copies"))
    top = keys.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.sum("copies").alias("all")).where("all > 1 and refers_to is not null")
    once = F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    return keys.join(top, ["digest", "n"]).where(~once | (F.col("copies") > 1)).select("page_id", "digest", "refers_to", once.alias("once"))


def write_packages(pages: DataFrame, folder: str, date: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(package, records): a task's ZIP files, each closed once it has package_bytes. Of equal payloads of LEAST bytes or more,
    the largest page_id has the response. date: WARC-Date of all records, as 2001-01-31T00:00:00Z; now, if none is given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    revisits = revisits_of(rows.select("page_id", "digest", F.length("payload").alias("n")))
    both = [F.coalesce("page_id", F.lit(0)), "digest", F.col("page_id").isNull()]  # a null id joins too
    keyed = rows.withColumn("k", F.xxhash64(*both)).repartition("k")
    revisits = revisits.withColumn("k", F.xxhash64(*both)).select("k", F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", "once")
    same = (F.col("k") == F.col("rk")) & F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    whole = keyed.join(revisits.withColumnRenamed("k", "rk"), same, "left").select("page_id", "url", "payload", "digest", "refers_to", F.coalesce("once", F.lit(False)).alias("once"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean()
        store, path = _store(folder)
        name = out = package = None
        lines: list[str] = []
        answered: set[tuple] = set()  # (page_id, digest) that several rows share, and that one of this task has

        def close():
            package.end()
            package.begin(INDEX)
            for i in range(0, len(lines), 10_000):
                package.write(("\n".join(lines[i : i + 10_000]) + "\n").encode())
            package.end()
            package.close()
            out.close()
            return pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "records": pa.array([len(lines)], pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for page_id, url, payload, digest, refers_to, once in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                    if package is None:
                        store.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.wacz"
                        out = store.open_output_stream(f"{path}/{name}")
                        package, lines = PackageWriter(out), []
                        package.begin(ARCHIVE)
                    if once and (page_id, digest) not in answered:
                        answered.add((page_id, digest))
                        refers_to = None
                    fields = [("WARC-Date", date), ("WARC-Target-URI", clean_url(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Bytes", str(len(payload)))]
                    if refers_to is None:
                        own = record_id(page_id, digest, "" if len(payload) >= LEAST and page_id is not None else f"{name}/{len(lines)}")
                        data = record([("WARC-Type", "response"), ("WARC-Record-ID", own), *fields], payload)
                    else:
                        own = record_id(page_id, digest, f"{name}/{len(lines)}")
                        data = record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To", str(refers_to)), *fields], b"")
                    packed = _gzip(data)
                    lines.append(f"{'' if page_id is None else page_id} {package.write(packed)} {len(packed)}")
                    if package.at >= package_bytes:
                        yield close()
                        package = None
        if package is not None:
            yield close()
        trim()

    return whole.mapInArrow(run, "package string, records long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def read_records(packages: DataFrame, block: int = 4 << 20) -> DataFrame:
    """A row per record, with what it says of its payload; a response's payload is held against that. Ranges of up to `block`
    bytes are read at a time, and a package's records are dealt to several tasks."""
    spark = packages.sparkSession

    def ranges():
        def each(package, records):
            store, path = _store(package)
            with store.open_input_file(path) as f:
                members = directory(lambda at, n: f.read_at(n, at), f.size())
                (start, _), (at, n) = members[ARCHIVE], members[INDEX]
                first, sizes, held = start, [], 0
                for line in io.StringIO(f.read_at(n, at).decode()):
                    _, offset, length = line.rstrip("\n").rsplit(" ", 2)
                    if sizes and (held + int(length) > block or start + int(offset) != first + held):
                        yield package, first, sizes
                        sizes, held = [], 0
                    if not sizes:
                        first = start + int(offset)
                    sizes.append(int(length))
                    held += int(length)
                if sizes:
                    yield package, first, sizes

        return each

    def records():
        def each(package, at, sizes):
            store, path = _store(package)
            with store.open_input_file(path) as f:
                raw = memoryview(f.read_at(sum(sizes), at))
            start = 0
            for size in sizes:
                fields, payload = parse(zlib.decompress(raw[start : start + size], 31))
                start += size
                digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-bytes"])
                if fields["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
                    raise ValueError("a payload differs from its size or digest")
                page, refers = fields["x-page-id"], fields.get("x-refers-to")
                yield int(page) if page else None, fields.get("warc-target-uri"), n, digest, fields["warc-type"], None if refers is None else int(refers), fields["warc-record-id"], fields.get("warc-refers-to")

        return each

    parts = map_rows(packages, ranges, "package string, at long, sizes array<long>")
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "package", "at")
    return map_rows(dealt, records, RECORDS)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages. Revisits are resolved: size and digest are those of the response that a revisit refers to
    by its record id, and a revisit without one fails."""
    found = save(read_records(packages), "warc-records")
    whole = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    # a hot response has one row for all that refer to it: only the ids asked for are joined, and one row comes back for each
    asked = found.where("refers_to_id is not null").groupBy("refers_to_id").agg(F.max("payload_bytes").alias("said"), F.max("payload_digest").alias("said_d"), F.min("payload_bytes").alias("least"), F.min("payload_digest").alias("least_d"))
    held = asked.join(whole, "refers_to_id", "left")
    bad = held.where(F.col("n").isNull() | (F.col("n") != F.col("said")) | (F.col("d") != F.col("said_d")) | (F.col("n") != F.col("least")) | (F.col("d") != F.col("least_d")))
    if not bad.isEmpty():
        raise ValueError("a revisit's response isn't there or differs from what the revisit says")
    return found.drop("record_id", "refers_to_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = save(write_packages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"), "warc-packages")
    return read_packages(packages).drop("url")
