"""Window panes with revisions, by a stateful stream with in-band punctuation.

Clicks are cut into batches, written under spark.checkpoint.dir and fed in order to one Structured Streaming query, which is started
anew for each batch on one checkpoint. Every batch, an empty one too, carries a control row for each state shard with W, the greatest
event time of earlier batches, and whether it is the last. Rows bear their batch's W, so a row for a closed pane is told from
others where it is read; the others are summed by pane in the tasks that read them, so a pane's shard gets a few sums however many
rows it has, and late rows go to any shard. A shard keeps its panes in MapState: sums update them, then the control row settles
which are emitted, revised and forgotten.

A row without ts is dropped. Of rows with one click_id the first to arrive counts, then the one with the least ts, kind and value
(nulls first); rows without a click_id are one click, whose number is read as an empty string. Without arrived_at a row arrives
at its ts. Cents of a null or non-finite value, or beyond 10^15, are 0. A null kind is `none`. An empty table gives no rows. Other columns are
ignored, whatever they are called. Times are taken without a zone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .common import _arrow_schema, lean, shared_dir, table, trim

BATCHES, SHARDS = 8, 128
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Microseconds after a pane's end from which it is due and closed.
DUE, CLOSED = 6 * HOUR, 4 * DAY
#: Rows as they are fed: clicks with a null shard, and control rows.
FED = "batch int, kind string, hour long, click_id long, cents long, w long, shard int, last boolean"
#: Rows as a shard gets them: sums of a pane, single late rows, and control rows. what: p, l, c.
SENT = "shard int, what string, batch int, kind string, hour long, click_id long, n long, cents long, w long, last boolean"
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
PANE, TOTAL = "kind string, hour long", "n long, cents long, emitted boolean"


def cut(clicks: DataFrame) -> DataFrame:
    """batch, kind, hour, click_id, cents and event (microseconds since 1970) of each click."""
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    down = lambda c, unit: F.expr(f"({c} - pmod({c}, {unit}L)) div {unit}L")
    rows = clicks.where("ts is not null").select(F.col("click_id").cast("long").alias("click_id"), micros("coalesce(arrived_at, ts)").alias("arrived"), micros("ts").alias("at"), F.col("kind").cast("string").alias("kind"), F.col("value").cast("double").alias("value"))
    # least() of whole rows is summed up before the shuffle, so a repeated id costs a row a task
    once = rows.groupBy("click_id").agg(F.min(F.struct("arrived", "at", "kind", "value")).alias("r")).select("click_id", "r.*")
    placed = once.withColumn("day", down("arrived", DAY)).withColumn("q", F.expr(f"pmod(day, {BATCHES})"))
    late = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))) % 30 - 23)
    placed = placed.withColumn("batch", F.least(F.lit(BATCHES - 1), F.col("q") + late).cast("int")).withColumn("event", F.col("at") - (F.col("day") - F.col("q")) * DAY)
    cents = F.floor(100 * F.col("value") + 0.5)
    sound = ~F.isnan("value") & (F.abs("value") <= 1e13)
    return placed.select("batch", F.coalesce("kind", F.lit("none")).alias("kind"), down("event", HOUR).alias("hour"), "click_id", F.coalesce(F.when(sound, cents), F.lit(0)).cast("long").alias("cents"), "event")


def _pane_shard(kind: str, hour: int, shards: int) -> int:
    return zlib.crc32(f"{hour}:{kind}".encode("utf-8", "surrogatepass")) % shards


def combine(batches: Iterator[pa.RecordBatch], shards: int, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's rows as a shard gets them: late ones singly as they come, the others as sums of panes at the end."""
    lean()
    sums: pa.Table | None = None
    by = ["batch", "kind", "hour", "w"]
    for batch in batches:
        fed = pa.Table.from_batches([batch])
        control = pc.is_valid(fed["shard"])
        if (marks := fed.filter(control)).num_rows:
            yield from _sent(marks, fields, what="c", shard=marks["shard"], n=0)
        rows = fed.filter(pc.invert(control))
        closed = pc.fill_null(pc.less_equal(pc.add(pc.multiply(pc.add(rows["hour"], 1), HOUR), CLOSED), rows["w"]), False)
        if (late := rows.filter(closed)).num_rows:
            spread = (np.asarray(pc.fill_null(late["click_id"], 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield from _sent(late, fields, what="l", shard=pa.array((spread % np.uint64(shards)).astype(np.int32)), n=1)
        if (rest := rows.filter(pc.invert(closed))).num_rows:
            now = rest.append_column("n", pa.array(np.ones(rest.num_rows, np.int64))).select([*by, "n", "cents"])
            sums = _summed(now if sums is None else pa.concat_tables([sums, now]), by)
    if sums is not None:
        home = [_pane_shard(k, h, shards) for k, h in zip(sums["kind"].to_pylist(), sums["hour"].to_pylist())]
        yield from _sent(sums, fields, what="p", shard=pa.array(home, pa.int32()), n=sums["n"])
    trim()


def _summed(rows: pa.Table, by: list[str]) -> pa.Table:
    out = rows.group_by(by).aggregate([("n", "sum"), ("cents", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*by, "n", "cents"])


def _sent(rows: pa.Table, fields: pa.Schema, **own) -> Iterator[pa.RecordBatch]:
    size = rows.num_rows
    columns = []
    for f in fields:
        value = own.get(f.name, rows[f.name] if f.name in rows.column_names else None)
        if not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.nulls(size, f.type) if value is None else pa.array([value] * size, f.type)
        columns.append(value.cast(f.type))
    yield from pa.table(columns, schema=fields).to_batches()


class Panes(StatefulProcessor):
    """A shard's panes. State: for each pane its totals and whether they have been emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getMapState("panes", PANE, TOTAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[tuple, tuple[int, int]] = {}
        control, stamps = None, set()
        for frame in rows:
            stamps |= {None if pd.isna(w) else int(w) for w in frame["w"].unique()}
            late = frame[frame["what"] == "l"]
            if len(late):
                yield _records([(b, h, c, 1, m, "late", k) for b, h, c, m, k in zip(late["batch"], late["hour"], late["click_id"], late["cents"], late["kind"])])
            for k, h, n, m in frame.loc[frame["what"] == "p", ["kind", "hour", "n", "cents"]].itertuples(index=False):
                before = added.get((k, int(h)), (0, 0))
                added[k, int(h)] = before[0] + int(n), before[1] + int(m)
            for b, w, last in frame.loc[frame["what"] == "c", ["batch", "w", "last"]].itertuples(index=False):
                control = int(b), None if pd.isna(w) else int(w), bool(last)
        if control is None or stamps != {control[1]}:
            raise ValueError(f"shard {key}: no control row, or rows of another batch: {control}, {stamps}")
        out = self._update(added, control[0]) + self._settle(*control)
        if out:
            yield _records(out)

    def _update(self, added: dict, batch: int) -> list[tuple]:
        """Adds a batch's sums; panes that were emitted before are revised."""
        out = []
        for pane, (n, cents) in added.items():
            old = self.panes.getValue(pane) if self.panes.containsKey(pane) else None
            new = (n + old[0], cents + old[1], old[2]) if old else (n, cents, False)
            if new[2]:
                out += [(batch, pane[1], -1, old[0], old[1], "retract", pane[0]), (batch, pane[1], -1, new[0], new[1], "replace", pane[0])]
            self.panes.updateValue(pane, new)
        return out

    def _settle(self, batch: int, w: int | None, last: bool) -> list[tuple]:
        """Emits what is due, forgets what is closed, and at the end emits the rest."""
        out = []
        for (kind, hour), (n, cents, emitted) in list(self.panes.iterator()):
            end = (hour + 1) * HOUR
            due = w is not None and w >= end + DUE
            if not emitted and (due or last):
                out.append((batch, hour, -1, n, cents, "emit" if due else "final", kind))
                self.panes.updateValue((kind, hour), (n, cents, True))
            if w is not None and w >= end + CLOSED:
                self.panes.removeKey((kind, hour))
        return out

    def close(self) -> None:
        pass


def _records(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"])
    return out.astype({"batch": "int64", "hour": "int64", "click_id": "Int64", "n_rows": "int64", "cents": "int64"})


#: Settings of the stream's session. MapState needs this store. A batch starts the query anew, so no task has use for a store that
#: stays loaded; a shard's state is small, so room for its logs isn't taken beforehand and only changes are uploaded.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _session(spark: SparkSession) -> SparkSession:
    """A session of the stream's own, which leaves the caller's settings alone."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in STORE.items():
        own.conf.set(key, value)
    return own


def revised_panes(clicks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The records of all batches: late, emit, retract, replace, final."""
    spark = clicks.sparkSession
    base = f"{shared_dir(spark)}/panes-{uuid.uuid4().hex}"
    rows = cut(clicks)
    rows.write.partitionBy("batch").parquet(f"{base}/batches")
    rows = spark.read.schema(rows.schema).option("basePath", f"{base}/batches").parquet(f"{base}/batches")
    # a row for each batch
    tops = {r["batch"]: r["top"] for r in rows.groupBy("batch").agg(F.max("event").alias("top")).collect()}
    fields, w = _arrow_schema(spark, SENT), None
    own = _session(spark)
    for batch in range(BATCHES):
        stamp = F.lit(w).cast("long").alias("w")
        data = rows.where(F.col("batch") == batch).select(F.lit(batch).alias("batch"), "kind", "hour", "click_id", "cents", stamp, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("boolean").alias("last"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("hour", "long"), ("click_id", "long"), ("cents", "long"))]
        control = spark.range(0, shards, 1, 1).select(F.lit(batch).alias("batch"), *none, stamp, F.col("id").cast("int").alias("shard"), F.lit(batch == BATCHES - 1).alias("last"))
        data.unionByName(control).write.mode("append").parquet(f"{base}/in")
        fed = own.readStream.schema(FED).parquet(f"{base}/in")
        sent = fed.mapInArrow(lambda batches, n=shards, f=fields: combine(batches, n, f), SENT)
        found = sent.groupBy("shard").transformWithStateInPandas(Panes(), RECORDS, "Append", "None")
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        query.awaitTermination()
        w = max((x for x in (w, tops.get(batch)) if x is not None), default=None)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for used in ("batches", "in", "state"):
        fs.delete(at(f"{base}/{used}"), True)
    return spark.read.schema(RECORDS).parquet(f"{base}/out")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revised_panes(table(spark, sf_dir, "clicks"))
