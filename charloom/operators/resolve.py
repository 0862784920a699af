"""Entity resolution: which character names are one.

Pairs are found by joins (aliases by equality, strings by names.py, vectors by pivots); only pairs with a signal go on. Merges depend on
each other, but only within a group of names that can merge at all; each group is folded in the list's order by a task of its
own, without the pairs that are alike as strings alone. What waits for a decision follows from when names were merged away;
there the pairs by strings, which grow with the square of the names, go from where they are found straight to the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from charloom.functions import similarity as S
from charloom.functions.shared import save
from charloom.functions.similarity import similar_of

from .graph import components
from .index import counted
from .names import alike
from .tiles import compare_stretches, numbered

#: Vectors that distances are taken to, and rows in a stretch of vectors.
PIVOTS, STRETCH = 6, 4096


def mean_embeddings(entries: DataFrame, vector: str = "embedding", top: int = 5) -> DataFrame:
    """Per character the mean vector of its first entries by category and chunk; empty texts among them don't count."""
    rank = F.when(F.col("category") == "speech", 0).when(F.col("category") == "appearance", 1).otherwise(2)
    first = Window.partitionBy("character_name").orderBy(rank, "chunk_index", "char_start")
    kept = entries.withColumn("_r", F.row_number().over(first)).where((F.col("_r") <= top) & (F.col("text") != ""))
    parts = kept.select("character_name", F.posexplode(vector).alias("p", "v")).groupBy("character_name", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy("character_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("vector"))


def place(mentions: str = "mention_count", name: str = "character_name") -> Column:
    """A name's place in the list, as a value that orders: most mentioned first, then by name."""
    return F.struct((-F.col(mentions)).alias("n"), F.col(name).alias("name"))


def string_pairs(names: DataFrame, lev_max: int = 2, jw_min: float = 0.85) -> DataFrame:
    """(a, b, oa, ob) of names in list order (ord) that are alike as strings; lev_max is two at most."""
    return alike(names, jw_min, lev_max)


def vector_pairs(vectors: DataFrame, cos_min: float = 0.8) -> DataFrame:
    """(a, b, oa, ob, embedding_score), oa < ob, of names whose vectors have a cosine of cos_min or more; exact. vectors: name, ord,
    vector. Unit vectors are sorted by their nearest pivot and its distance; by the triangle inequality two vectors within reach
    differ by no more than that in their distance to any pivot, so stretches whose distances lie further apart never meet.
    Null, empty, zero and non-finite vectors have no pairs, nor have vectors of unequal length."""
    d = F.transform("vector", lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(d, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(d, lambda x: x != 0), F.lit(False))
    rows = vectors.where(sound).select("name", "ord", F.col("vector").cast("array<double>").alias("vector"))
    # a few vectors by hash; they decide what is skipped, not what is found
    chosen = [r["vector"] for r in rows.orderBy(F.xxhash64("name"), "name").limit(PIVOTS).select("vector").collect()]
    reach = float(np.sqrt(max(0.0, 2 - 2 * cos_min))) + 1e-9
    kind = rows.schema["ord"].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            found = []
            for v in batch["vector"].to_pylist():
                u = np.array(v) / np.linalg.norm(v)
                # a pivot of another length says nothing, so all such vectors are at one distance
                found.append([np.linalg.norm(u - np.array(p) / np.linalg.norm(p)) if len(p) == len(v) else 4.0 for p in chosen])
            far = np.array(found, float).reshape(len(found), len(chosen))
            nearest = far.argmin(axis=1) if len(chosen) else np.zeros(len(found), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(far[:, k])) for k in range(len(chosen))), pa.array(nearest), pc.list_value_length(batch["vector"]).cast(pa.float64())], names=[*batch.schema.names, *sides[:-1], "nearest", "dims"])

    sides = [*(f"d{k}" for k in range(len(chosen))), "dims"]
    schema = f"name string, ord {kind}, vector array<double>, {''.join(f'{s} double, ' for s in sides[:-1])}nearest long, dims double"

    def compare(one: pa.Table, two: pa.Table | None) -> pa.Table:
        def units(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.asarray(t["dims"]).astype(int)
            out = np.zeros((len(sizes), width))
            out[np.arange(width) < sizes[:, None]] = np.concatenate([np.asarray(c.flatten()) for c in t["vector"].chunks])
            return out / np.linalg.norm(out, axis=1)[:, None], sizes

        other = two or one
        width = int(max(pc.max(one["dims"]).as_py(), pc.max(other["dims"]).as_py()))
        (u, m), (v, n) = units(one), units(other)
        found = []
        for k in range(0, len(u), 512):
            score = u[k : k + 512] @ v.T
            hit = (score >= cos_min) & (m[k : k + 512, None] == n)
            i, j = np.nonzero(np.triu(hit, k + 1) if two is None else hit)
            found.append((i + k, j, score[i, j]))
        i, j, s = (np.concatenate([f[k] for f in found] or [np.zeros(0)]) for k in range(3))
        i, j = i.astype(int), j.astype(int)
        return pa.table({"a": one["name"].take(i), "b": other["name"].take(j), "oa": one["ord"].take(i), "ob": other["ord"].take(j), "s": s})

    near = rows.mapInArrow(placed, schema)
    found = compare_stretches(near, ["dims", "nearest", *sides[:1]], STRETCH, compare, f"a string, b string, oa {kind}, ob {kind}, s double", sides, reach)
    first = F.col("oa") < F.col("ob")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), F.least("oa", "ob").alias("oa"), F.greatest("oa", "ob").alias("ob"), F.col("s").alias("embedding_score"))


def _alias_pairs(names: DataFrame) -> DataFrame:
    """(a, b, oa, ob), oa < ob: one is among the other's aliases. names: name, ord, aliases."""
    own = names.select("name", "ord", F.explode("aliases").alias("alias")).join(names.select(F.col("name").alias("alias"), F.col("ord").alias("o2")), "alias").where("name != alias")
    first = F.col("ord") < F.col("o2")
    return own.select(F.when(first, F.col("name")).otherwise(F.col("alias")).alias("a"), F.when(first, F.col("alias")).otherwise(F.col("name")).alias("b"), F.least("ord", "o2").alias("oa"), F.greatest("ord", "o2").alias("ob")).distinct()


def listed(entries: DataFrame) -> DataFrame:
    """(name, ord, aliases, mention_count) of all characters."""
    return counted(entries).select(F.col("character_name").alias("name"), place().alias("ord"), "aliases", "mention_count")


KEYS = ("a", "b", "oa", "ob")


def _similar(a: str, b: str, lev_max: int, jw_min: float) -> Column:
    """The similarity rule for the names in two columns."""
    a, b = F.col(a), F.col(b)
    return F.coalesce(S.similar_natively(a, b, lev_max) | ((a != "") & (b != "") & (S.jaro_winkler(a, b) >= jw_min)), F.lit(False))


def _singly(aliased: DataFrame, lev_max: int, jw_min: float, near: DataFrame | None = None, later: DataFrame | None = None) -> DataFrame:
    """The pairs that something else than their strings ties, each once, with all of their signals: by aliases, by vectors (near), and
    by aliases that merges give (later). They are compared by themselves, so the many by strings go through no join."""
    kinds = [aliased.select(*KEYS, F.lit(True).alias("alias_hit"), F.lit(False).alias("later"), F.lit(None).cast("double").alias("embedding_score"))]
    if near is not None:
        kinds.append(near.select(*KEYS, F.lit(False).alias("alias_hit"), F.lit(False).alias("later"), "embedding_score"))
    if later is not None:
        kinds.append(later.select(*KEYS, F.lit(False).alias("alias_hit"), F.lit(True).alias("later"), F.lit(None).cast("double").alias("embedding_score")))
    rows = reduce(DataFrame.unionByName, kinds).groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in ("alias_hit", "later", "embedding_score")))
    string, score = _similar("a", "b", lev_max, jw_min), F.col("embedding_score")
    return save(rows.select(*KEYS, "alias_hit", "later", string.alias("string_hit"), score.isNotNull().alias("embedding_hit"), F.coalesce(score, F.lit(0.0)).alias("embedding_score")), "singly")


def _apart(names: DataFrame, singly: DataFrame) -> DataFrame:
    """names with those that they are compared with by themselves."""
    return names.join(singly.groupBy(F.col("a").alias("name")).agg(F.collect_list("b").alias("apart")), "name", "left")


def _near(entries: DataFrame, names: DataFrame, vector: str | None, cos_min: float) -> DataFrame | None:
    if not vector:
        return None
    return save(vector_pairs(mean_embeddings(entries, vector).withColumnRenamed("character_name", "name").join(names.select("name", "ord"), "name"), cos_min), "near")


def signals(entries: DataFrame, lev_max: int = 2, jw_min: float = 0.85, vector: str | None = None, cos_min: float = 0.8, names: DataFrame | None = None) -> DataFrame:
    """Pairs with at least one signal: (a, b, oa, ob, alias_hit, string_hit, embedding_hit, embedding_score, hit_count)."""
    names = save(listed(entries), "names") if names is None else names
    singly = _singly(_alias_pairs(names), lev_max, jw_min, _near(entries, names, vector, cos_min))
    rest = string_pairs(_apart(names, singly), lev_max, jw_min)
    rest = rest.select(*KEYS, F.lit(False).alias("alias_hit"), F.lit(True).alias("string_hit"), F.lit(False).alias("embedding_hit"), F.lit(0.0).alias("embedding_score"))
    out = singly.drop("later").select(*rest.columns).unionByName(rest)
    return out.withColumn("hit_count", F.col("alias_hit").cast("int") + F.col("string_hit").cast("int") + F.col("embedding_hit").cast("int"))


def decide(pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """action (merge from two signals on, pending at one) and the target: more mentions, else the longer name, else a. Without
    names, the mentions are those of the pairs' places."""
    if names is None:
        out = pairs.withColumn("ca", -F.col("oa.n")).withColumn("cb", -F.col("ob.n"))
    else:
        na, nb = names.select(F.col("character_name").alias("a"), F.col("mention_count").alias("ca")), names.select(F.col("character_name").alias("b"), F.col("mention_count").alias("cb"))
        out = pairs.join(na, "a").join(nb, "b")
    a_wins = F.when(F.col("ca") != F.col("cb"), F.col("ca") > F.col("cb")).otherwise(F.length("a") >= F.length("b"))
    out = out.withColumn("target", F.when(a_wins, F.col("a")).otherwise(F.col("b"))).withColumn("source", F.when(a_wins, F.col("b")).otherwise(F.col("a")))
    return out.withColumn("action", F.when(F.col("hit_count") >= 2, "merge").otherwise("pending")).drop("ca", "cb")


@dataclass
class Folded:
    """What a fold decides: merges (source, target) and the place of each, pairs that wait, and the aliases that targets were
    given on the way, each with the place of the merge."""

    merged: list[tuple[str, str]] = field(default_factory=list)
    pending: list[tuple[str, str, int]] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)
    given: list[tuple[str, str, tuple[int, int]]] = field(default_factory=list)

    @property
    def total_actions(self) -> int:
        return len(self.merged) + len(self.pending)

    def final(self) -> dict[str, str]:
        """The name that each source ends up as."""
        out = dict(self.merged)
        for s, _ in reversed(self.merged):
            out[s] = out.get(out[s], out[s])
        return out


@dataclass
class Resolution:
    """merges: (source, target, final, oa, ob), final being the name that the source ends up as; waiting: (a, b, oa, ob, hits), pairs
    left for someone to decide, worked out when they are asked for. oa and ob are the names' places in the list, and order both.
    The lists are for reports on a few names."""

    merges: DataFrame
    find_waiting: Callable[[], DataFrame]

    @cached_property
    def waiting(self) -> DataFrame:
        return self.find_waiting()

    @cached_property
    def merged(self) -> list[tuple[str, str]]:
        return [(r.source, r.target) for r in self.merges.orderBy("oa", "ob").collect()]

    @cached_property
    def pending(self) -> list[tuple[str, str, int]]:
        return [(r.a, r.b, r.hits) for r in self.waiting.orderBy("oa", "ob").collect()]

    @property
    def total_actions(self) -> int:
        return self.merges.count() + self.waiting.count()


MERGES = "source string, target string, final string, oa bigint, ob bigint, given array<string>"


def _groups(known: DataFrame, singly: DataFrame, lev_max: int, jw_min: float) -> DataFrame:
    """(name, root): groups that no merge goes across. known: (name, other), a name's aliases that are names.

    A merge needs two signals. What merges make comes by aliases alone: a name can be given what those of its group know. So groups
    start from the pairs that have two signals as they are, and grow by each name that one of a group knows while any of
    the group is like it, till none is left. Strings are compared for these alone, not for all names."""
    ties = save(singly.where("string_hit and embedding_hit or alias_hit and (string_hit or embedding_hit)").select("a", "b"), "ties")
    near = singly.where("embedding_hit").select("a", "b")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    grown = None
    while True:
        roots = save(components(ties).select(F.col("node").alias("name"), "root"), "roots")
        open_ = roots if grown is None else roots.join(roots.join(grown, "name").select("root").distinct(), "root", "left_semi")
        beyond = known.join(open_, "name").join(roots.select(F.col("name").alias("other"), F.col("root").alias("theirs")), "other", "left")
        beyond = beyond.where("theirs is null or theirs != root").select("root", "other").distinct()
        met = beyond.join(open_, "root")
        alike_ = met.where(_similar("name", "other", lev_max, jw_min) | _similar("other", "name", lev_max, jw_min)).select("name", "other")
        by_vector = met.join(near, (F.col("name") == F.col("a")) & (F.col("other") == F.col("b"))).select("name", "other")
        more = save(alike_.unionByName(by_vector).distinct(), "more")
        if more.isEmpty():
            return roots
        ties = save(ties.unionByName(more.toDF("a", "b")), "ties")
        grown = more.select("name").distinct()


def _merges(names: DataFrame, singly: DataFrame, lev_max: int, jw_min: float) -> DataFrame:
    """Folds each group of names that may merge, in a task of its own."""
    known = names.select("name", F.explode("aliases").alias("other")).distinct()
    known = save(known.join(names.select(F.col("name").alias("other")), "other").where("name != other").select("name", "other"), "known")
    roots = _groups(known, singly, lev_max, jw_min)
    knows = known.join(roots, "name", "left_semi").groupBy("name").agg(F.collect_list("other").alias("knows"))
    members = names.join(roots, "name").join(knows, "name", "left").select("root", "name", "ord", "mention_count", "knows", F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("hits"))
    # a group's pairs with a vector signal; strings are compared when an alias makes them matter
    pairs = singly.where("embedding_hit").join(roots.withColumnRenamed("name", "a"), "a").join(roots.select(F.col("name").alias("b"), F.col("root").alias("theirs")), "b").where("root = theirs")
    hits = pairs.select("root", F.col("a").alias("name"), F.col("oa").alias("ord"), F.lit(None).cast("long").alias("mention_count"), F.lit(None).cast("array<string>").alias("knows"), "b", (F.col("string_hit").cast("int") + 1).alias("hits"))

    def work(group: pa.Table) -> pa.Table:
        listed, at, met = {}, {}, {}
        for name, place, mentions, aliases, b, n in zip(*(group[c].to_pylist() for c in ("name", "ord", "mention_count", "knows", "b", "hits"))):
            if b is None:
                listed[name], at[name] = (mentions, set(aliases or [])), place
            else:
                met[name, b] = n
        found = fold(listed, met, alike=lambda a, b: similar_of(a, b, lev_max, jw_min))
        order, final = sorted(listed, key=lambda n: (-listed[n][0], n)), found.final()
        given: dict[tuple, list[str]] = {}
        for _, alias, where in found.given:
            given.setdefault(where, []).append(alias)
        rows = [{"source": s, "target": t, "final": final[s], "oa": at[order[i]], "ob": at[order[j]], "given": sorted(given.get((i, j), []))} for (s, t), (i, j) in zip(found.merged, found.places)]
        return pa.Table.from_pylist(rows, schema=fields)

    fields = pa.schema([("source", pa.string()), ("target", pa.string()), ("final", pa.string()), ("oa", pa.int64()), ("ob", pa.int64()), ("given", pa.list_(pa.string()))])
    return save(members.unionByName(hits).groupBy("root").applyInArrow(work, MERGES), "merges")


def _waiting(names: DataFrame, aliased: DataFrame, near: DataFrame | None, merges: DataFrame, lev_max: int, jw_min: float) -> DataFrame:
    """Pairs with a signal that come up before either name is merged away, and aren't merged themselves. An alias that a merge gave
    to its target counts for the target's pairs from then on. Pairs by strings alone are left out where they are found."""
    given = merges.select(F.col("target").alias("name"), F.explode("given").alias("other"), F.struct("oa", "ob").alias("since"))
    ords = names.select("name", "ord")
    given = given.join(ords, "name").join(ords.select(F.col("name").alias("other"), F.col("ord").alias("o2")), "other")
    first = F.col("ord") < F.col("o2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    given = given.select(pick("name", "other").alias("a"), pick("other", "name").alias("b"), F.least("ord", "o2").alias("oa"), F.greatest("ord", "o2").alias("ob"), "since")
    later = given.where(F.struct("oa", "ob") > F.col("since")).select(*KEYS).distinct()
    singly = _singly(aliased, lev_max, jw_min, near, later)
    gone = merges.select(F.col("source").alias("name"), F.struct("oa", "ob").alias("gone"))
    rest = string_pairs(_apart(names, singly).join(gone, "name", "left"), lev_max, jw_min)
    hits = F.col("string_hit").cast("int") + F.col("embedding_hit").cast("int") + F.greatest("alias_hit", "later").cast("int")
    few_ = singly.select(*KEYS, hits.alias("hits"))
    here = F.struct("oa", "ob")
    for n in "ab":
        few_ = few_.join(gone.select(F.col("name").alias(n), F.col("gone").alias(f"gone_{n}")), n, "left")
    there = F.coalesce(F.col("gone_a") > here, F.lit(True)) & F.coalesce(F.col("gone_b") > here, F.lit(True))
    return few_.where(there).select(*KEYS, "hits").unionByName(rest.select(*KEYS, F.lit(1).alias("hits")))


def resolve(entries: DataFrame, auto_merge: bool = True, lev_max: int = 2, jw_min: float = 0.85, vector: str | None = None, cos_min: float = 0.8) -> Resolution:
    """Goes through the pairs in list order. A merged name is skipped from then on, and its aliases pass to the target, which
    can give the target's later pairs an alias signal."""
    names, _ = numbered(listed(entries).withColumnRenamed("ord", "place"), "place", name="ord")
    aliased = save(_alias_pairs(names), "aliased")
    near = _near(entries, names, vector, cos_min)
    merges = _merges(names, _singly(aliased, lev_max, jw_min, near), lev_max, jw_min) if auto_merge else entries.sparkSession.createDataFrame([], MERGES)
    return Resolution(merges.drop("given"), lambda: _waiting(names, aliased, near, merges, lev_max, jw_min))


def fold(listed: dict[str, tuple[int, set[str]]], hits_of: dict[tuple[str, str], int], auto_merge: bool = True, alike: Callable[[str, str], bool] | None = None) -> Folded:
    """The decisions in list order. listed: mentions and aliases of each name; hits_of: the hits besides aliases of a pair in
    list order; alike: for pairs that aren't there, whether they have one. Pairs that only this would tell of don't come up, so the
    merges are whole, and of what waits only the pairs by aliases or in hits_of. A name meets only those it has a hit with, those among its aliases and those it is an alias of, so the work
    follows the pairs with a signal, not all pairs of names."""
    names = sorted(listed, key=lambda n: (-listed[n][0], n))
    order = {n: i for i, n in enumerate(names)}
    counts, aliases = {n: c for n, (c, _) in listed.items()}, {n: set(x) for n, (_, x) in listed.items()}
    meets: dict[str, set[int]] = {n: set() for n in names}
    for a, b in hits_of:
        meets[a].add(order[b])
    for n, known in aliases.items():
        for x in known & order.keys():
            meets[x].add(order[n])
    out, gone = Folded(), set()
    for a in names:
        if a in gone:
            continue
        waiting = [*meets[a], *(order[x] for x in aliases[a] & order.keys())]
        heapq.heapify(waiting)
        at = order[a]
        while waiting and a not in gone:
            nxt = heapq.heappop(waiting)
            if nxt <= at or names[nxt] in gone:
                continue
            at, b = nxt, names[nxt]
            besides = hits_of.get((a, b))
            hits = (b in aliases[a] or a in aliases[b]) + (besides if besides is not None else alike is not None and alike(a, b))
            if hits >= 2 and auto_merge:
                a_wins = counts[a] > counts[b] if counts[a] != counts[b] else len(a) >= len(b)
                target, source = (a, b) if a_wins else (b, a)
                out.merged.append((source, target))
                out.places.append((order[a], order[b]))
                gone.add(source)
                passed = (aliases[source] | {source}) - {target}
                out.given += [(target, x, (order[a], order[b])) for x in passed - aliases[target]]
                aliases[target] = (aliases[target] | passed) - {target}
                counts[target] += counts[source]
                if a_wins:
                    for x in passed & order.keys():
                        heapq.heappush(waiting, order[x])
                else:
                    for x in passed & order.keys():
                        meets[x].add(order[b])
            elif hits:
                out.pending.append((a, b, hits))
    return out


def merge_map(spark: SparkSession, resolution: Resolution) -> DataFrame:
    """(source, target) with chains followed to their end, for index.merge()."""
    return resolution.merges.select("source", F.col("final").alias("target"))
