"""The character index: entries as a table, its updates, lists and searches.

Updates are DataFrame to DataFrame; IndexStore keeps the table on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charloom.functions.similarity import cosine



def upsert(entries: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key, one stays."""
    new = new.dropDuplicates([key])
    return entries.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def of_character(entries: DataFrame, name: str, category: str | None = None) -> DataFrame:
    own = entries.where(F.col("character_name") == name)
    return (own.where(F.col("category") == category) if category else own).orderBy("chunk_index", "char_start")


def counted(entries: DataFrame) -> DataFrame:
    """characters() in no order. Rows of one name, category and aliases are counted first, in a plain hash aggregation, so that
    few rows are left for the sets."""
    rows = entries.groupBy("character_name", "category", "aliases").agg(F.count(F.lit(1)).alias("n"))
    by = rows.groupBy("character_name", "category").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("aliases"))).alias("a"))
    out = by.groupBy("character_name").agg(F.sum("n").alias("mention_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("aliases"))
    return out.withColumn("aliases", F.array_remove(F.array_remove("aliases", F.col("character_name")), F.lit("")))


def characters(entries: DataFrame) -> DataFrame:
    """Per character: mentions, mentions by category, and distinct aliases other than the name; most mentioned first, then by
    name."""
    return counted(entries).orderBy(F.desc("mention_count"), "character_name")


def merge(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Renames sources to targets: pairs (source, target), each source once. A moved row's aliases get the old name, and lose
    the new one. All merges go through one join."""
    moved = pairs.where((F.col("source") != F.col("target")) & (F.col("source") != "") & (F.col("target") != "")).select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    joined = entries.join(moved, F.col("character_name") == F.col("_s"), "left")
    aliases = F.array_remove(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("_s")), F.col("_t"))
    return joined.withColumn("aliases", F.when(F.col("_t").isNull(), F.col("aliases")).otherwise(aliases)).withColumn("character_name", F.coalesce("_t", "character_name")).drop("_s", "_t")


def _holds(c: str, query: str) -> Column:
    """LIKE %query% with the signs % and _ as wildcards; ASCII letters in either case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    small = query.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(F.col(c), upper, lower).like(f"%{small}%")


def search_text(entries: DataFrame, query: str, name: str | None = None, k: int = 10) -> DataFrame:
    """Entries whose text or name holds the query, in a fixed order."""
    found = entries.where(_holds("text", query) | _holds("character_name", query))
    found = found.where(F.col("character_name") == name) if name else found
    return found.orderBy("character_name", "chunk_index", "char_start", "uuid").limit(k)


def search_vector(entries: DataFrame, vector: list[float], name: str | None = None, k: int = 10, column: str = "embedding") -> DataFrame:
    """The k entries nearest by cosine; ties by uuid. Sorted in part per task, so the driver's share is k rows a task."""
    found = entries.where(F.col("character_name") == name) if name else entries
    return found.withColumn("score", cosine(F.col(column), F.array(*(F.lit(float(x)) for x in vector)))).orderBy(F.desc("score"), "uuid").limit(k)


def delete_chunk(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Without the entries of the chunks given by corpus_uuid, source and chunk_index."""
    return entries.join(chunks.select("corpus_uuid", "source", "chunk_index").distinct(), ["corpus_uuid", "source", "chunk_index"], "left_anti").select(*entries.columns)


def resolve_name(text: str, listed: DataFrame) -> str | None:
    """A number is the place in the list; else the name itself; else the only name that holds the text or is held by it."""
    text = text.strip()
    if not text:
        return None
    if text.isdigit() and int(text) > 0:
        # each task brings its first ones, as many as the place says
        row = listed.orderBy(F.desc("mention_count"), "character_name").select("character_name").offset(int(text) - 1).first()
        if row:
            return row.character_name
    exact = listed.where(F.col("character_name") == text).first()
    if exact:
        return text
    near = listed.where(F.contains("character_name", F.lit(text)) | F.contains(F.lit(text), F.col("character_name"))).select("character_name").limit(2).collect()
    return near[0].character_name if len(near) == 1 else None


def metadata(entries: DataFrame) -> DataFrame:
    return entries.select("uuid", "character_name", "category", "source", "corpus_uuid", "char_start", "char_end", "chunk_index", F.array_join("aliases", ",").alias("aliases"))


from .index_store import IndexStore  # noqa: E402, F401
