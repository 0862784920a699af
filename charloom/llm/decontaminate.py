"""Benchmark decontamination by templates, with DataFrame functions only.

Tokens (runs of letters and digits) become template tokens: a number, a name (a token with an ASCII capital first, not at the
start of a sentence nor all in capitals) and a unit (after a number) are typed placeholders, any other token is itself. Windows
of WINDOW template tokens of the documents are hash-joined with those of the benchmark items. A window of fewer than LITERALS
tokens besides placeholders says little, so its tokens themselves are its hash: it is found only word for word. Matches of one
document and item at one shift are an alignment; the slots of a run in it are consistent if each value of the item stands for
one value in the document. A document is reported for an item when a run has RUN matching template tokens (all but one of them,
for shorter items) and consistent slots, whatever the alignment's other runs hold, so a question with other numbers and names
is found as well as a copy. Items of SHORT to WINDOW - 1 tokens are found word for word, as a whole.

Null and empty texts have no tokens. Each distinct text of a doc_id is judged by itself, so repeated ids don't mix; a document
is reported once per doc_id and item. A null doc_id is reported as null. Items shorter than SHORT are left out, since they can't
be told from chance. Items of equal text are reported each. Empty tables give no rows. Only the columns named here are read. The items' windows
are broadcast only while they are fewer than BROADCAST_ROWS; beyond that (doc_id, text hash, position, hash) are shuffled, and
the tokens are fetched for matches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

WINDOW = 8
RUN = 13
LITERALS = 4
SHORT = 4
#: Window starts in a row that is worked on.
PIECE = 512
BROADCAST_ROWS = 500_000
#: Placeholders, and words that are units after a number.
NUMBER, NAME, UNIT = 1, 2, 3
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l hl s ms min h d day days week weeks month months year years hour hours minute minutes "
    "second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents percent degree degrees "
    "watt watts volt volts ampere amperes joule joules hz khz mhz ghz kb mb gb tb kmh mph"
).split()


MARKS = ".!?"


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _plain(t: Column) -> Column:
    """A token without the sentence marks that its run ends with."""
    return F.rtrim(t, F.lit(MARKS))


def tokenized(rows: DataFrame) -> DataFrame:
    """Adds tokens, which keep the sentence marks behind them, in place of the text."""
    runs = F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}.!?]+")
    return rows.withColumn("tokens", F.filter(runs, lambda t: (t >= "0") & ~F.startswith(t, F.lit("?")))).drop("text")


def pieces(rows: DataFrame) -> DataFrame:
    """A row per PIECE window starts of a text, with `first`, the place of its first one: their tokens, the rest of the last window,
    and the token before them, which the first code depends on. So no row grows with its text, nor do the arrays made of it."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice("tokens", F.greatest(i, F.lit(1)), PIECE + WINDOW).alias("tokens")))
    others = [c for c in rows.columns if c != "tokens"]
    return rows.select(*others, F.explode(cut).alias("_piece")).select(*others, "_piece.first", "_piece.tokens")


def templates(rows: DataFrame) -> DataFrame:
    """Adds tokens and codes to rows with a text."""
    return coded(tokenized(rows))


def coded(rows: DataFrame) -> DataFrame:
    """Adds codes: per token its placeholder or its hash in small letters. A capital makes a name only within a sentence and
    where small letters follow, so that sentence starts and texts in capitals keep their words."""

    def code(t: Column, i: Column) -> Column:
        before = F.get("tokens", i - 1)
        ends = F.right(before, F.lit(1)).isin(*MARKS)
        name = (t >= "A") & (t < "[") & (i > 0) & ~ends & (t != F.upper(t))
        unit = (i > 0) & _is_number(before) & F.lower(_plain(t)).isin(UNITS)
        return F.when(_is_number(t), F.lit(NUMBER).cast("long")).when(name, F.lit(NAME).cast("long")).when(unit, F.lit(UNIT).cast("long")).otherwise(F.xxhash64(F.lower(_plain(t))))

    return rows.withColumn("codes", F.transform("tokens", code))


def windows(rows: DataFrame, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Adds hs: (at, h, width) of each window: of WINDOW template tokens by doubling, which needs WINDOW to be 8, and of the
    widths in `lengths`, of the tokens themselves."""
    for name, of, step in (("h2", "codes", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        rows = rows.withColumn(name, _paired(of, step, F.xxhash64))
    literal = F.transform("codes", lambda c: (~c.isin(NUMBER, NAME, UNIT)).cast("int"))
    rows = rows.withColumn("n1", literal)
    for name, of, step in (("n2", "n1", 1), ("n4", "n2", 2), ("n8", "n4", 4)):
        rows = rows.withColumn(name, _paired(of, step, lambda x, y: x + F.coalesce(y, F.lit(0))))

    def said(at: Column, width: int) -> Column:
        return F.xxhash64(F.lit(width), F.transform(F.slice("tokens", at + 1, width), lambda t: F.lower(_plain(t))))

    # zipped, not looked up by position: within a lambda Spark would work n8 out anew for every element
    both = F.slice(F.arrays_zip("h8", "n8"), 1, F.greatest(F.size("h8") - (WINDOW - 1), F.lit(0)))
    whole = F.transform(both, lambda z, i: F.struct(i.alias("at"), F.when(z["n8"] >= LITERALS, z["h8"]).otherwise(said(i, WINDOW)).alias("h"), F.lit(WINDOW).alias("width")))

    def wide(w: int) -> Column:
        return F.transform(F.expr(f"slice(n1, 1, greatest(size(n1) - {w - 1}, 0))"), lambda _, i: F.struct(i.alias("at"), said(i, w).alias("h"), F.lit(w).alias("width")))

    return rows.withColumn("hs", F.concat(whole, *map(wide, lengths)) if lengths else whole).drop("h2", "h4", "h8", "n1", "n2", "n4", "n8")


def _paired(of: str, step: int, join: Callable[[Column, Column], Column]) -> Column:
    return F.transform(of, lambda x, i: join(x, F.get(of, i + step)))


def benchmark_windows(items: DataFrame, lengths: tuple[int, ...] = ()) -> DataFrame:
    """A row per window of the items; an item of fewer than WINDOW tokens has one, its whole."""
    own = windows(templates(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()), lengths)
    own = own.select("item_id", F.size("tokens").alias("n_tokens"), "tokens", "codes", F.explode_outer("hs").alias("w")).where("w is not null")
    own = own.where(F.col("w.width") == F.least(F.lit(WINDOW), "n_tokens"))
    part = lambda c: F.slice(c, F.col("w.at") + 1, F.col("w.width"))
    return own.select("w.h", "w.width", "item_id", F.col("w.at").alias("item_at"), "n_tokens", part("codes").alias("item_codes"), part("tokens").alias("item_words"))


def short_lengths(items: DataFrame) -> tuple[int, ...]:
    """The lengths, of SHORT to WINDOW - 1 tokens, that items have."""
    sizes = templates(items.select(F.col("text").cast("string").alias("text"))).select(F.size("tokens").alias("n")).where(F.col("n").between(SHORT, WINDOW - 1)).distinct()
    return tuple(sorted(r.n for r in sizes.collect()))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per window of a document that an item has: doc_id, row (which of the id's texts), at, and the item's window with the
    document's tokens there."""
    lengths = short_lengths(items)
    bench = benchmark_windows(items, lengths)
    few = bench.count() <= BROADCAST_ROWS
    text = F.col("text").cast("string")
    cut = pieces(tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))))
    own = windows(coded(cut), lengths)
    # the place in the piece is that in the text less `first`; one on where the token before is held
    held_before = (F.col("first") > 0).cast("int")
    inside = (F.col("at") >= held_before) & (F.col("at") < held_before + PIECE)
    words = F.slice("tokens", F.col("at") + 1, F.col("width")).alias("doc_words")
    columns = ["doc_id", "row", (F.col("first") - held_before + F.col("at")).alias("at"), "item_id", "item_at", "n_tokens", "item_codes", "item_words"]
    # the outer form, since for the inner one Spark infers a filter on h and works all of its folds out again, inside each other
    if few:
        found = own.select("doc_id", "row", "first", "tokens", F.explode_outer("hs").alias("w")).select("doc_id", "row", "first", "tokens", "w.at", "w.h", "w.width")
        return found.join(F.broadcast(bench), ["h", "width"]).where(inside).select(*columns, words)
    found = own.select("doc_id", "row", "first", F.explode_outer("hs").alias("w")).select("doc_id", "row", "first", "w.at", "w.h", "w.width")
    found = save(found.where(inside).join(bench, ["h", "width"]), "template-matches")
    # the tokens of the pieces that have matches
    held = cut.select(F.col("doc_id").alias("d_id"), F.col("row").alias("d_row"), F.col("first").alias("d_first"), "tokens")
    held = held.join(found.select(F.col("row").alias("d_row"), F.col("first").alias("d_first")).distinct(), ["d_row", "d_first"], "left_semi").dropDuplicates(["d_id", "d_row", "d_first"])
    same = (F.col("row") == F.col("d_row")) & (F.col("first") == F.col("d_first")) & F.col("doc_id").eqNullSafe(F.col("d_id"))
    return found.join(held, same).select(*columns, words)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item found in it: the longest run, the tokens covered, and whether all slots are the same."""
    by = _aligned(docs, items)
    return by.groupBy("doc_id", "item_id").agg(F.max(F.array_max("good.n")).cast("long").alias("longest_run"), F.max("covered").cast("long").alias("covered"), F.max("n_tokens").cast("long").alias("item_tokens"), F.max("same").alias("same_slots"))


def _aligned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments of texts with items that are good enough; `row` is the hash of the text."""
    found = matches(docs, items)
    # slot pairs of the window: (item's value, document's value)
    pairs = F.transform(F.filter(F.arrays_zip("item_codes", "item_words", "doc_words"), lambda z: z["item_codes"].isin(NUMBER, NAME, UNIT)), lambda z: F.struct(_plain(z["item_words"]).alias("item"), _plain(z["doc_words"]).alias("doc")))
    found = found.select("doc_id", "row", "item_id", "n_tokens", (F.col("at") - F.col("item_at")).alias("shift"), F.struct("item_at", pairs.alias("slots")).alias("w"))
    # an alignment has at most as many rows as the item has windows
    by = found.groupBy("doc_id", "row", "item_id", "n_tokens", "shift").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    # a run goes on while the next window touches or overlaps the last one
    by = by.withColumn("width", F.least(F.lit(WINDOW), "n_tokens"))
    by = by.withColumn("begins", F.expr(f"transform(filter(ws, (w, i) -> i = 0 or w.item_at - ws[i - 1].item_at > {WINDOW}), w -> w.item_at)"))
    by = by.withColumn("runs", F.expr("transform(begins, (b, i) -> filter(ws, w -> w.item_at >= b and (i + 1 >= size(begins) or w.item_at < get(begins, i + 1))))"))
    by = by.withColumn("runs", F.expr("transform(runs, r -> struct(element_at(r, -1).item_at - r[0].item_at + width as n, array_distinct(flatten(r.slots)) as slots))"))
    by = by.withColumn("covered", F.expr("aggregate(runs, 0, (n, r) -> n + r.n)"))
    one_value = "size(array_distinct(r.slots.item)) = size(r.slots)"
    by = by.withColumn("good", F.expr(f"filter(runs, r -> r.n >= least({RUN}, n_tokens - 1) and {one_value})")).where(F.size("good") > 0)
    same = ~F.exists(F.flatten("ws.slots"), lambda z: z["item"] != z["doc"])
    return by.withColumn("same", same)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows are told apart by id and text: another text of the same id stays.
    Rows without a doc_id stay, null texts too; repeated rows go or stay together. An empty table of items takes nothing."""
    gone = _aligned(docs, items).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    same = (F.col("d.doc_id") == F.col("g._id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("g._row"))
    return docs.alias("d").join(gone.alias("g"), same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
