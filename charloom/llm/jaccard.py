"""N-gram Jaccard join by T-occurrence search.

A document's set has its distinct 5-word shingles (words in small ASCII letters; a text of fewer words is one shingle). Sets
are linked when their intersection is at least `threshold` per cent of their union; the result has each document's component.

1. Postings (shingle, set) are dealt into buckets by shingle; equal sets are one. Shingles of a single set go no further.
2. Per set, the shared shingles are ordered from rare to frequent. A set links only if it shares one of its first
   n - ceil(threshold * n) + 1 shingles, so sets whose first shingles are all their own are done. The lists of these first
   shingles are the short ones; they tell which sets need to meet.
3. Sets that such lists chain together are searched together (`search`): per set, its short inverted lists are merged through
   a heap that skips what can't reach T - L occurrences, the L long ones are probed by binary search (DivideSkip), and sets
   that reach the required overlap are tied.
4. A chain too large for one task is cut into blocks by size class and hash. Each block is searched by itself and against the
   first block of its class, which is linear in the chain. Only sets that this leaves outside the chain's largest component are
   then asked, in blocks, against all sets of the neighbouring classes: pairs within the largest component need no look.
   A chain whose sets are like each other without being linked still costs its sets outside times its sets.

Empty or null texts have the empty set and are linked with nothing. Every row gets a result, repeated rows included; a null
doc_id is no one's component. Ties need no rule, since a component is named by its smallest doc_id. An empty table gives no
rows. Only the two columns are read, whatever others are called.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import _arrow_schema, drop, lean, save, table, texts, trim
from .components import components

SHINGLE = 5
THRESHOLD = 80
#: Sets in a block, and bytes of their shingles, up to which a chain is searched in one piece.
BLOCK_SETS = 700
BLOCK_BYTES = 8 << 20
#: Sets that a block's others are compared with directly before the search.
LEADERS = 4
#: Rows of block counts up to which they are broadcast.
BROADCAST_ROWS = 100_000


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(lengths: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles, sorted by both, and per document the set's size and signature."""
    starts = packed.starts_of(lengths)
    n = np.maximum(lengths - width + 1, 0)
    at = np.repeat(starts[:-1], n) + packed.within(n)
    h, owner = packed.windows(words, width)[at], np.repeat(np.arange(len(lengths)), n)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        alone = [packed.windows(words[starts[i] : starts[i + 1]], int(lengths[i]))[0] + np.uint64(lengths[i]) for i in short]
        h, owner = np.concatenate([h, packed.mix(np.array(alone, np.uint64))]), np.concatenate([owner, short])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    size = np.bincount(owner, minlength=len(lengths)).astype(np.int64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(packed.mix(h ^ packed.M3))])
    ends = np.cumsum(size)
    return owner, h, size, packed.mix(total[ends] - total[ends - size] + size.astype(np.uint64) * packed.M3).view(np.int64)


def postings(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Kind 0: postings by bucket. Kind 2: (doc_id, size, signature) of the task's documents."""

    def take(ids, lengths, words):
        owner, h, size, sig = shingle_sets(lengths, words, width)
        mark = packed.mix(packed.mix(ids.view(np.uint64)).sum(keepdims=True))
        rows = [(2, int(mark[0] % np.uint64(1 << 30)), packed.pack(ids, size, sig))]
        first = np.zeros(len(ids), bool)
        first[np.unique(sig, return_index=True)[1]] = True
        keep = np.flatnonzero(first[owner])
        for b, s in packed.deal(packed.bucket_of(h[keep], buckets), buckets):
            s = keep[s]
            own, counts = packed.counted(owner[s])
            rows.append((0, b, packed.pack(sig[own], size[own].astype(np.uint32), counts.astype(np.uint32), packed.squeeze(h[s]))))
        yield packed.rows_batch(rows)

    def run(batches):
        yield from packed.chunked(batches, tokens, take)

    return docs.mapInArrow(run, packed.ROWS)


def shared(blocks: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Postings of shingles that two sets or more have, by group of sets, with the number of sets. Kind 2 passes through, dealt
    over all buckets, so a bucket's share of it doesn't grow with the input."""

    def run(key, rows):
        lean()
        out, h, sig, size = [], [], [], []
        for k, g, block in zip(rows.column("kind").to_pylist(), rows.column("key").to_pylist(), rows.column("block").to_pylist()):
            if k == 2:
                out.append((2, g % groups, block))
                continue
            raw = packed.unpack(block)
            counts = np.frombuffer(raw[2], np.uint32).astype(np.int64)
            h.append(packed.widen(raw[3]))
            sig.append(np.repeat(np.frombuffer(raw[0], np.int64), counts))
            size.append(np.repeat(np.frombuffer(raw[1], np.uint32), counts))
        if h:
            h, sig, size = np.concatenate(h), np.concatenate(sig), np.concatenate(size)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twin = np.zeros(len(h), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            h, sig, size = h[twin], sig[twin], size[twin]
            order = np.lexsort((sig, h))
            h, sig, size = h[order], sig[order], size[order]
            if len(h):
                head = np.concatenate([[True], h[1:] != h[:-1]])
                new = head | np.concatenate([[True], sig[1:] != sig[:-1]])
                h, sig, size = h[new], sig[new], size[new]
                number = np.cumsum(head[new]) - 1
                df = np.bincount(number)[number]
                h, sig, size, df = (x[df > 1] for x in (h, sig, size, df))
                order = np.argsort(sig, kind="stable")
                h, sig, size, df = h[order], sig[order], size[order], df[order]
                for g, at in packed.deal(np.mod(sig, groups), groups):
                    own, counts = packed.counted(sig[at])
                    ends = np.cumsum(counts) - 1
                    out.append((0, g, packed.pack(own, size[at][ends], counts.astype(np.uint32), h[at], np.minimum(df[at], 0xFFFFFFFF).astype(np.uint32))))
        made = packed.rows_table(out)
        del h, sig, size, out
        trim()
        return made

    return blocks.groupBy(F.expr(f"case when kind = 0 then key else pmod(hash(key), {buckets}) end")).applyInArrow(run, packed.ROWS)


SETS = "kind int, sig long, size long, doc_id long, short int, shingles array<long>"


def candidates(shared_blocks: DataFrame, threshold: int) -> DataFrame:
    """Kind 0: sets that may link, their shared shingles from rare to frequent, and how many lists are short for them.
    Kind 2: the documents' sets."""
    fields = _arrow_schema(shared_blocks.sparkSession, SETS)

    def run(key, rows):
        import pyarrow as pa

        lean()
        sig, size, h, df, out = [], [], [], [], []
        for k, block in zip(rows.column("kind").to_pylist(), rows.column("block").to_pylist()):
            raw = packed.unpack(block)
            if k == 2:
                ids, n, s = (np.frombuffer(x, np.int64) for x in raw)
                out.append(pa.Table.from_arrays([pa.array(np.full(len(ids), 2, np.int32)), pa.array(s), pa.array(n), pa.array(ids, mask=ids == packed.NULL_ID), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.list_(pa.int64()))], names=fields.names).cast(fields))
                continue
            counts = np.frombuffer(raw[2], np.uint32).astype(np.int64)
            sig.append(np.repeat(np.frombuffer(raw[0], np.int64), counts))
            size.append(np.repeat(np.frombuffer(raw[1], np.uint32), counts))
            h.append(np.frombuffer(raw[3], np.uint64))
            df.append(np.frombuffer(raw[4], np.uint32))
        if sig:
            sig, size, h, df = np.concatenate(sig), np.concatenate(size).astype(np.int64), np.concatenate(h), np.concatenate(df)
            order = np.lexsort((h, df, sig))
            sig, size, h = sig[order], size[order], h[order]
            own, counts = packed.counted(sig)
            starts = packed.starts_of(counts)
            n = size[starts[:-1]]
            short = (n - (threshold * n + 99) // 100 + 1) - (n - counts)
            for part in np.array_split(np.flatnonzero(short > 0), max(1, len(own) // 2000)):
                if len(part):
                    at = np.repeat(starts[part], counts[part]) + packed.within(counts[part])
                    lists = pa.ListArray.from_arrays(pa.array(packed.starts_of(counts[part]).astype(np.int32)), pa.array(h[at].view(np.int64)))
                    out.append(pa.Table.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(own[part]), pa.array(n[part]), pa.nulls(len(part), pa.int64()), pa.array(short[part].astype(np.int32)), lists], names=fields.names).cast(fields))
        del sig, size, h, df
        trim()
        return pa.concat_tables(out) if out else fields.empty_table()

    return shared_blocks.groupBy("key").applyInArrow(run, SETS)


class Ties:
    """Union-find over the sets of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def required(a, b, threshold: int):
    """Overlap of sets of sizes a and b from which they link: 100 * x >= threshold * (a + b - x)."""
    return -(-threshold * (a + b) // (100 + threshold))


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(member, lists that hold it) of the members of `need` lists or more. The lists ascend; a heap has the next member of
    each. Members that fewer lists are left for are skipped by binary search."""
    n, at, out = len(lists), [0] * len(lists), []
    heap = [x[0] * n + i for i, x in enumerate(lists)]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while len(heap) >= need:
        member = heap[0] // n
        taken = []
        while heap and heap[0] // n == member:
            taken.append(pop(heap) % n)
        if len(taken) >= need:
            out.append((member, len(taken)))
            to = member + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(pop(heap) % n)
            if not heap:
                break
            to = heap[0] // n
        for i in taken:
            x = lists[i]
            k = at[i] = bisect_left(x, to, at[i])
            if k < len(x):
                push(heap, x[k] * n + i)
    return out


class Lists:
    """Inverted lists of the sets numbered `which`, as their ranks in ascending order."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray, rank: np.ndarray):
        lengths = np.array([len(sets[i]) for i in which], np.int64)
        flat = np.concatenate([sets[i] for i in which]) if len(which) else np.empty(0, np.int64)
        owner = np.repeat(rank[which].astype(np.int32), lengths)
        order = np.lexsort((owner, flat))
        self.keys, self.members = flat[order], owner[order]

    def of(self, shingles: np.ndarray) -> list[np.ndarray]:
        lo, hi = np.searchsorted(self.keys, shingles), np.searchsorted(self.keys, shingles, "right")
        return [self.members[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if a < b]


def search(sizes: np.ndarray, sets: list[np.ndarray], root: np.ndarray, ask: np.ndarray, held: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Ties between sets to ask for and sets held (`ask` is within `held` or apart from it), besides those that equal roots
    tell. Sets are arrays of distinct shared shingles, sizes those of the whole sets."""
    n = len(sets)
    lengths = np.array([len(x) for x in sets])
    ties, out = Ties(n), []
    for i, j in zip(range(n), np.unique(root, return_index=True)[1][np.unique(root, return_inverse=True)[1]].tolist()):
        ties.tie(i, j)

    def tie(i: int, j: int) -> None:
        if ties.tie(i, j):
            out.append((i, j))

    # sets that link with a leader need no search among each other
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    led: set[int] = set()
    for i in np.argsort(sizes, kind="stable")[np.linspace(0, n - 1, min(n, 64)).astype(int)].tolist():
        if len(led) >= LEADERS or ties.root(i) in led:
            continue
        common = np.bincount(owner[np.isin(flat, sets[i])], minlength=n)
        for j in np.flatnonzero(common >= required(sizes, sizes[i], threshold)).tolist():
            tie(i, j)
        led = {ties.root(k) for k in led} | {ties.root(i)}
    del flat, owner
    # a larger set comes first: it is asked for with those that are as large at least
    by_rank = np.lexsort((np.arange(n), -sizes))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    home = np.array([ties.root(i) for i in range(n)])
    most = home == np.bincount(home).argmax()
    for asked, lists in ((ask & ~most, np.flatnonzero(held)), (ask & most, np.flatnonzero(held & ~most & ~ask))):
        if asked.any() and len(lists):
            index = Lists(sets, lists, rank)
            for q in by_rank[asked[by_rank]].tolist():
                _ask(q, index, sizes, lengths, sets[q], by_rank, rank, asked, ties, tie, threshold)
    return out


def _ask(q: int, index: Lists, sizes, lengths, shingles, by_rank, rank, asked, ties: Ties, tie, threshold: int) -> None:
    """DivideSkip for one set: ties it to the sets of the index that reach the required overlap."""
    t = -(-threshold * int(sizes[q]) // 100)
    lists = index.of(shingles)
    if len(lists) < t:
        return
    lists.sort(key=len)
    # DivideSkip's number of long lists: T / (mu * log M + 1)
    n_long = min(t - 1, int(t / (0.01 * math.log2(len(lists[-1]) + 1) + 1)), len(lists) - 1)
    found = merge_skip([x.tolist() for x in lists[: len(lists) - n_long]], t - n_long)
    home, alive, counts = ties.root(q), [], []
    for r, c in found:
        i = int(by_rank[r])
        # of two sets that are both asked for, the later one meets the earlier
        if i != q and not (asked[i] and r > rank[q]) and lengths[i] >= t and 100 * sizes[q] >= threshold * sizes[i] and 100 * sizes[i] >= threshold * sizes[q] and ties.root(i) != home:
            alive.append(r)
            counts.append(c)
    if not alive:
        return
    ranks, total = np.array(alive, np.int32), np.array(counts)
    need, left = required(sizes[by_rank[ranks]], sizes[q], threshold), n_long
    for part in lists[len(lists) - n_long :]:  # long lists, by binary search
        total += part[np.minimum(np.searchsorted(part, ranks), len(part) - 1)] == ranks
        left -= 1
        keep = total + left >= need
        if not keep.all():
            ranks, need, total = ranks[keep], need[keep], total[keep]
            if not len(ranks):
                return
    for r in ranks[total >= need].tolist():
        tie(q, int(by_rank[r]))


PARTS = ["chain", "p", "q", "r", "s"]


def _searched(dealt: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ties within each group of PARTS. side 0: asked for and held; 1: held only; 2: asked for only."""

    def run(key, rows):
        import pyarrow as pa

        lean()
        sig = rows.column("sig").to_numpy()
        order = np.argsort(sig)
        sizes, side, root = (rows.column(c).to_numpy()[order] for c in ("size", "side", "root"))
        lists = pa.chunked_array(rows.column("shingles").chunks).combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        found = search(sizes, [values[at[i] : at[i + 1]] for i in order], root, side != 1, side != 2, threshold) if len(sig) > 1 else []
        a, b = zip(*found) if found else ((), ())
        made = pa.table({"a": pa.array(sig[order][list(a)], pa.int64()), "b": pa.array(sig[order][list(b)], pa.int64())})
        trim()
        return made

    return dealt.select(*PARTS, "side", "sig", "size", "root", "shingles").groupBy(*PARTS).applyInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """A saved table, broadcast if its rows are few enough."""
    held = save(df, "jaccard-room")
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def links(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) signatures: ties that connect what the links connect."""
    # sets that share a short list, around the smallest of the list
    lists = sets.select("sig", F.explode(F.slice("shingles", 1, "short")).alias("h"))
    heads = lists.groupBy("h").agg(F.min("sig").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    meets = lists.join(heads.select("h", "head"), "h").where("sig != head").select(F.col("sig").alias("a"), F.col("head").alias("b")).distinct()
    chains = components(meets).select(F.col("node").alias("sig"), F.col("root").alias("chain"))
    # linked sets are of the same size class or of neighbouring ones
    step = math.log(100 / threshold) * 1.01
    held = save(sets.select("sig", "size", "shingles").join(chains, "sig").withColumn("cls", F.floor(F.log("size") / F.lit(step)).cast("int")), "jaccard-chains")
    many = (F.col("n") > BLOCK_SETS) | (F.col("bytes") > BLOCK_BYTES)
    by_class = held.groupBy("chain", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles") * F.lit(8)).alias("bytes"))
    large = by_class.groupBy("chain").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where(many).select("chain")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    room = _small(by_class.join(large, "chain", "left_semi").select("chain", "cls", blocks))
    dealt = held.join(room, ["chain", "cls"], "left").withColumn("own", F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1))).cast("int"))
    # block 0 of a class comes to each other block and is compared there, but not with itself again
    at = F.when(F.col("blocks").isNull() | (F.col("own") > 0), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = dealt.select("*", F.explode(at).alias("q")).withColumns({"p": F.when(F.col("blocks").isNull(), F.lit(None).cast("int")).otherwise(F.col("cls")), "r": F.lit(0), "s": F.lit(0), "root": F.col("sig"), "side": (F.col("q") != F.col("own")).cast("int")})
    ties = save(_searched(first, threshold), "jaccard-ties")
    if room.isEmpty():
        return ties
    # of large chains, what is outside the largest component asks all neighbouring classes
    roots = components(ties).select(F.col("node").alias("sig"), "root")
    whole = save(dealt.where("blocks is not null").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "jaccard-large")
    most = _small(whole.groupBy("chain", "root").count().groupBy("chain").agg(F.max_by("root", F.struct("count", "root")).alias("most")))
    rest = whole.join(most, "chain").where("root != most").drop("most", "blocks")
    asked = _small(rest.groupBy("chain", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles") * F.lit(8)).alias("bytes")).select("chain", F.col("cls").alias("p"), blocks.alias("asked")))
    if asked.isEmpty():
        return ties
    near = F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))
    of_rest = rest.withColumn("p", F.col("cls")).join(asked, ["chain", "p"]).withColumn("q", F.pmod(F.xxhash64("sig", F.lit(1)), "asked").cast("int"))
    of_rest = of_rest.withColumn("r", near).join(room.select("chain", F.col("cls").alias("r"), "blocks"), ["chain", "r"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(2))
    of_all = whole.drop("blocks").withColumn("p", near).join(asked, ["chain", "p"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("asked") - 1))).withColumns({"r": F.col("cls"), "s": F.col("own"), "side": F.lit(1)})
    columns = [*PARTS, "side", "sig", "size", "root", "shingles"]
    return ties.unionByName(save(_searched(of_rest.select(columns).unionByName(of_all.select(columns)), threshold), "jaccard-ties"))


def _classed(rows: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): the members (doc_id, n_shingles, sig), and (sig, root) of the sets that link with others."""
    n = packed.buckets_for(rows)
    found = save(candidates(shared(postings(rows, n, width), packed.groups_for(n), n), threshold), "jaccard-sets")
    roots = components(links(found.where("kind = 0").select("sig", "size", "short", "shingles"), threshold))
    return found.where("kind = 2").select("doc_id", F.col("size").alias("n_shingles"), "sig"), roots.select(F.col("node").alias("sig"), "root")


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, component_id). By set first, then by component, so a hot set or component is one row a task."""
    sets = members.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    rooted = sets.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")


def jaccard_components(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    members, roots = _classed(texts(docs), width, threshold)
    out = members.join(_named(members, roots), "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the rows that a smaller doc_id of their component stands for. Rows are told apart by id and text: of a repeated
    id's texts only the linked ones go. Rows without a doc_id stay, and so do equal rows of the smallest id, and null and empty
    texts."""
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = texts(docs.withColumn("_kept_row", row), "_kept_row")
    members, roots = _classed(own, width, threshold)
    ids = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    members = members.withColumnRenamed("doc_id", "row").distinct().join(ids, "row")
    gone = members.join(_named(members, roots), "sig").where("component_id < doc_id").select(F.col("row").alias("_kept_row"), F.col("doc_id").alias("_kept_id"))
    return docs.withColumn("_kept_row", row).alias("d").join(gone.alias("g"), (F.col("d._kept_row") == F.col("g._kept_row")) & (F.col("d.doc_id") == F.col("g._kept_id")), "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
