"""Resumable processing: which chunks of which corpus are done, as batch tables and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The corpora of `new` that aren't registered yet; append them."""
    return new.dropDuplicates(["corpus_uuid"]).join(registry.select("corpus_uuid"), "corpus_uuid", "left_anti").withColumn("processed_chunks", F.lit(0)).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def pending(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """Chunks that aren't done, or whose content has changed since."""
    done = processed.select("corpus_uuid", "chunk_uuid", "content_hash")
    return chunks.join(done, ["corpus_uuid", "chunk_uuid", "content_hash"], "left_anti").select(*chunks.columns)


def processed_hash(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """Adds the stored content_hash of each chunk, null if it isn't done."""
    return chunks.join(processed.select("corpus_uuid", "chunk_uuid", F.col("content_hash").alias("processed_hash")), ["corpus_uuid", "chunk_uuid"], "left")


def mark(processed: DataFrame, done: DataFrame) -> DataFrame:
    """Processed chunks with the new ones; a chunk that is marked again keeps its last row."""
    both = processed.withColumn("_n", F.lit(0)).unionByName(done.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("corpus_uuid", "chunk_uuid").orderBy(F.desc("_n"), F.desc("processed_at"), F.desc("content_hash"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n")


def progress(registry: DataFrame, processed: DataFrame) -> DataFrame:
    """(corpus_uuid, processed, total) for each registered corpus."""
    n = processed.groupBy("corpus_uuid").agg(F.count(F.lit(1)).alias("processed"))
    return registry.select("corpus_uuid", F.col("total_chunks").cast("long").alias("total")).join(n, "corpus_uuid", "left").select("corpus_uuid", F.coalesce("processed", F.lit(0)).alias("processed"), "total")


def refresh(registry: DataFrame, processed: DataFrame) -> DataFrame:
    """The registry with its processed_chunks counted anew."""
    n = progress(registry, processed).select("corpus_uuid", F.col("processed").alias("_p"))
    return registry.join(n, "corpus_uuid").withColumn("processed_chunks", F.col("_p").cast("int")).withColumn("updated_at", F.current_timestamp()).drop("_p")


def stream_new_chunks(source: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Runs work on each micro-batch of a streaming table of chunks, a chunk once: the batch's repeats go here, and the
    checkpoint keeps which files were read, so a restart goes on where it ended. work must be safe to repeat for a batch id."""

    def batch(df: DataFrame, number: int) -> None:
        work(df.dropDuplicates(["corpus_uuid", "chunk_uuid"]), number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
