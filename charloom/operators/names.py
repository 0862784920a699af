"""Which names are alike: within two edits, or by Jaro-Winkler.

No key tells apart names as short as these by Jaro-Winkler (with 45,000 names, a third of all pairs share any key that misses none),
so stretches of the sorted names are compared in blocks: a product of matrices bounds how many characters two names share,
sorted order bounds how long a prefix, and only what the bounds leave open is worked out, many pairs at a time, edits included.

Edits alone: short names meet by what is left of them with up to two characters deleted, longer ones by one of three segments
that the edits leave whole; both are hash joins within the JVM, and a bounded edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from charloom.functions.similarity import jaro_many

from .tiles import compare_stretches

#: Names up to this length meet by deletions, longer ones by segments; names of a length in between by both.
SHORT = 12
#: Names in a stretch, and in a block within it; pairs that are compared at a time.
STRETCH, BLOCK, PAIRS = 4096, 512, 16384
#: Names that a stretch grows to where there are many, and pairs found that are held until they are handed on.
LARGEST, HELD = 65536, 200_000
#: Names of more characters than a word has bits are compared without words.
BITS = 64
#: Classes of characters whose numbers are bounded, and how many of one class count singly.
CLASSES, LEVELS = 32, 3


def deletions(name: Column) -> Column:
    """What is left of a name with none, one or two characters deleted."""
    n = F.length(name)
    cut = lambda first, last: F.substring(name, first, last - first + 1)
    one = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(cut(F.lit(1), i - 1), cut(i + 1, n))))
    two = F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(cut(F.lit(1), i - 1), cut(i + 1, j - 1), cut(j + 1, n))))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(name), F.coalesce(one, none), F.coalesce(two, none)))


def _segments(name: Column, own: bool) -> Column:
    """Keys of three segments: a name's own, or all substrings that can be a segment of a name up to two characters shorter."""
    n = F.length(name)
    out = []
    for shorter in (0,) if own else (0, 1, 2):
        whole = n - shorter
        part = F.floor(whole / 3).cast("int")
        for i in range(3):
            start, size = part * i + 1, part if i < 2 else whole - part * 2
            for shift in (0,) if own else (-2, -1, 0, 1, 2):
                inside = (start + shift >= 1) & (start + shift + size <= n + 1)
                out.append(F.when(inside, F.concat_ws("\x00", whole.cast("string"), F.lit(str(i)), F.substring(name, start + shift, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def within_two_edits(names: DataFrame) -> DataFrame:
    """(a, b, oa, ob), oa < ob: names, each once, with an edit distance of up to two. names: name, ord."""
    key = F.xxhash64(F.col("key"))
    some = names.where("name != ''").select("name", "ord")
    # few bytes lead to many pairs, so the number of tasks isn't left to the bytes
    tasks = 4 * names.sparkSession.sparkContext.defaultParallelism
    short = some.where(F.length("name") <= SHORT + 2).select("name", "ord", F.explode(deletions(F.col("name"))).alias("key")).select("name", "ord", key.alias("key")).repartition(tasks, "key")
    met = short.select(F.col("name").alias("a"), F.col("ord").alias("oa"), "key").join(short.select(F.col("name").alias("b"), F.col("ord").alias("ob"), "key"), "key").where("oa < ob")
    long_ = some.where(F.length("name") > SHORT)
    own = long_.select(F.col("name").alias("s"), F.col("ord").alias("os"), F.explode(_segments(F.col("name"), True)).alias("key")).select("s", "os", key.alias("key"))
    all_ = long_.select(F.col("name").alias("t"), F.col("ord").alias("ot"), F.explode(_segments(F.col("name"), False)).alias("key")).select("t", "ot", key.alias("key"))
    first = F.col("os") < F.col("ot")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    longer = own.join(all_, "key").where("s != t").select(pick("s", "t", "a"), pick("os", "ot", "oa"), pick("t", "s", "b"), pick("ot", "os", "ob"))
    near = F.levenshtein("a", "b", 2)
    return met.select("a", "oa", "b", "ob").unionByName(longer).where((F.abs(F.length("a") - F.length("b")) <= 2) & (near >= 0)).select("a", "b", "oa", "ob").distinct()


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of names as rows padded with zeros, and lengths."""
    sizes = np.array([len(x) for x in names], np.int32)
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(names), max(1, int(sizes.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def winkler_many(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, weight: float = 0.1) -> np.ndarray:
    """Jaro-Winkler of rows of code points; needs no more than its first four characters besides jaro_many."""
    j = jaro_many(x, nx, y, ny)
    width = min(4, x.shape[1], y.shape[1])
    same = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(nx, ny)[:, None])
    return j + np.cumprod(same, axis=1).sum(axis=1) * weight * (1 - j)


class _Block:
    """A block of sorted names with what the bound and the comparison need. Characters are numbers of an alphabet, 0 for none."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, points: np.ndarray, at: int):
        self.codes, self.sizes, self.at = codes, sizes, at
        self.width = int(sizes.max(initial=1))
        self.heads = [{x.tobytes() for x in codes[:, :k]} for k in range(1, 5)]
        counts = np.zeros((len(sizes), CLASSES), np.int32)
        np.add.at(counts, (np.repeat(np.arange(len(sizes)), sizes), points[codes[codes > 0]] % CLASSES), 1)
        self.counts = (counts[:, :, None] > np.arange(LEVELS)).reshape(len(sizes), -1).astype(np.float32)
        self.more = np.maximum(counts - LEVELS, 0).sum(axis=1).astype(np.float32)
        self._places: dict[type, tuple[np.ndarray, np.ndarray]] = {}
        self.letters = len(points)

    def prefix(self, other: _Block) -> int:
        """The longest prefix, up to four characters, that any two names of the blocks can share."""
        for k in range(4, 0, -1):
            if not self.heads[k - 1].isdisjoint(other.heads[k - 1]):
                return k
        return 0

    def places(self, word: type) -> tuple[np.ndarray, np.ndarray]:
        """A number for each letter of the alphabet that the block has (else 0), and by name and that number the places of the
        letter, as bits."""
        if word not in self._places:
            own = np.zeros(self.letters, np.int64)
            some = np.unique(self.codes[self.codes > 0])
            own[some] = np.arange(1, len(some) + 1)
            table = np.zeros((len(self.sizes), len(some) + 1), word)
            rows, at = np.nonzero(self.codes[:, :BITS])
            np.bitwise_or.at(table, (rows, own[self.codes[rows, at]]), word(1) << at.astype(word))
            self._places[word] = own, table
        return self._places[word]


def _blocks(*sides: list[str]) -> list[list[_Block]]:
    """Blocks of each side's names, with one alphabet."""
    points, sizes = _codes([x for side in sides for x in side])
    real = np.arange(points.shape[1]) < sizes[:, None]
    letters, numbers = np.unique(points[real], return_inverse=True)
    codes = np.zeros(points.shape, np.int64)
    codes[real] = numbers + 1
    letters, out, first = np.append(np.zeros(1, letters.dtype), letters), [], 0
    for side in sides:
        cuts = [slice(first + k, first + min(k + BLOCK, len(side))) for k in range(0, len(side), BLOCK)]
        out.append([_Block(codes[c], sizes[c], letters, c.start - first) for c in cuts])
        first += len(side)
    return out


def _open(a: _Block, b: _Block, least: float, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose Jaro-Winkler may reach `least`, or that may be within `edits`: m shared characters bound Jaro by
    (m/|a| + m/|b| + 1) / 3, and e edits leave all but e of the longer name."""
    lift = 0.1 * a.prefix(b)
    needed = 3 * (least - lift) / (1 - lift) - 1
    shared = a.counts @ b.counts.T
    if a.more.any() and b.more.any():
        shared += np.minimum(a.more[:, None], b.more[None, :])
    n, m = np.maximum(np.arange(a.width + 1.0), 1)[:, None], np.maximum(np.arange(b.width + 1.0), 1)[None, :]
    enough = np.minimum(needed / (1 / n + 1 / m), np.maximum(n, m) - edits).astype(np.float32) - np.float32(1e-3)
    keep = shared >= enough[a.sizes].take(b.sizes, axis=1)
    if a is b:
        keep = np.triu(keep, 1)
    return np.nonzero(keep)


def _lowest(bits: np.ndarray) -> np.ndarray:
    return bits & (~bits + bits.dtype.type(1))


def _edits(met: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances by Myers' automaton: for each place of the left names, where its character is in the right ones, as bits."""
    word = met[0].dtype.type
    one = word(1)
    last, score = one << (m - 1).astype(word), m.copy()
    up, down = np.full(len(n), ~word(0)), np.zeros(len(n), word)
    for p in range(int(n.max(initial=0))):
        straight = (((met[p] & up) + up) ^ up) | met[p] | down
        more, less = down | ~(straight | up), straight & up
        score += (p < n) * ((more & last != 0).astype(score.dtype) - (less & last != 0))
        more, less = more << one | one, less << one
        up, down = less | ~(straight | more), more & straight
    return score


def _edits_of_long(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, most: int) -> np.ndarray:
    """Edit distances up to `most`, else most + 1, of rows of any length: only the diagonals next to the main one are worked out."""
    band = np.full((len(n), 2 * most + 3), most + 1)
    band[:, most + 1 : -1] = np.arange(most + 1)
    for i in range(1, int(n.max(initial=0)) + 1):
        new = np.full_like(band, most + 1)
        for d in range(max(-most, -i), most + 1):
            k, at = d + most + 1, i + d
            if at == 0:
                new[:, k] = min(i, most + 1)
            elif at <= y.shape[1]:
                new[:, k] = np.minimum(np.minimum(band[:, k] + (x[:, i - 1] != y[:, at - 1]), band[:, k + 1] + 1), np.minimum(new[:, k - 1] + 1, most + 1))
        band = np.where((i <= n)[:, None], new, band)
    far = np.abs(m - n) > most
    return np.where(far, most + 1, band[np.arange(len(n)), np.where(far, 0, m - n) + most + 1])


def _alike_if_long(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, least: float, edits: int) -> np.ndarray:
    x, n, y, m = a.codes[i], a.sizes[i], b.codes[j], b.sizes[j]
    good = winkler_many(x, n, y, m) >= least
    return good | (_edits_of_long(x, n, y, m, edits) <= edits) if edits >= 0 else good


def _alike_by_bits(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, least: float, edits: int) -> np.ndarray:
    """Which pairs of names, i of a and j of b, have a Jaro-Winkler of `least` or are within `edits` (-1: by Jaro-Winkler alone). The
    places of a name's characters are the bits of a word, so a character of the left names is worked out for all pairs in a
    few operations: matches as in jaro_of(), edits by Myers' automaton."""
    long = (a.sizes[i] > BITS) | (b.sizes[j] > BITS)
    if long.any():
        good = np.zeros(len(i), bool)
        good[long] = _alike_if_long(a, b, i[long], j[long], least, edits)
        good[~long] = _alike_by_bits(a, b, i[~long], j[~long], least, edits)
        return good
    word = np.uint32 if max(a.width, b.width) <= 32 else np.uint64
    one = word(1)
    own, table = b.places(word)
    letters = own[a.codes[:, : min(a.width, BITS)]]
    by_place, width, row = np.ascontiguousarray(letters.T), letters.shape[1], j * table.shape[1]
    n, m = a.sizes.take(i), b.sizes.take(j)
    last = int(n.max(initial=0))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    window = (one << (reach + 1).astype(word)) - one
    used, mine = np.zeros(len(i), word), np.zeros(len(i), word)
    met = [table.ravel().take(row + by_place[p].take(i)) for p in range(last)]
    for p in range(last):
        low = _lowest(met[p] & window & ~used)
        used |= low
        mine |= (low != 0).astype(word) << word(p)
        window = window << one | (p < reach)
    matched = np.bitwise_count(used).astype(np.int64)
    most = (matched / n + matched / m + 1) / 3
    maybe = np.nonzero((matched > 0) & (most + 0.1 * a.prefix(b) * (1 - most) >= least - 1e-9))[0]
    good = np.zeros(len(i), bool)
    # the matched characters of either side, in order
    x, y, left, right, matched, n2, m2 = mine[maybe], used[maybe], i[maybe], row[maybe], matched[maybe], n[maybe], m[maybe]
    moved = np.zeros(len(maybe), np.int64)
    for _ in range(int(matched.max(initial=0))):
        lx, ly = _lowest(x), _lowest(y)
        place = np.minimum(np.bitwise_count(lx - one), width - 1)
        moved += (lx != 0) & (table.ravel().take(right + letters.ravel().take(left * width + place)) & ly == 0)
        x, y = x ^ lx, y ^ ly
    score = (matched / n2 + matched / m2 + (matched - moved // 2) / matched) / 3
    same, prefix = np.ones(len(maybe), bool), np.zeros(len(maybe), np.int64)
    for p in range(min(4, a.width, b.width)):
        same &= (a.codes[left, p] == b.codes[j[maybe], p]) & (p < np.minimum(n2, m2))
        prefix += same
    good[maybe] = score + prefix * 0.1 * (1 - score) >= least
    if edits >= 0:
        rest = np.nonzero(~good & (np.abs(n - m) <= edits))[0]
        if len(rest):
            good[rest[_edits([x[rest] for x in met], n[rest], m[rest]) <= edits]] = True
    return good


def _left_out(one: pa.Table, other: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs, i of one and j of other, one of the names keeps apart."""
    out = np.zeros(len(i), bool)
    for x, y, p, q in ((one, other, i, j), (other, one, j, i)):
        sizes = pc.fill_null(pc.list_value_length(x["apart"]), 0).to_numpy()
        at = pc.index_in(pc.list_flatten(x["apart"]), y["name"].combine_chunks()).combine_chunks()
        met = pc.is_valid(at).to_numpy(zero_copy_only=False)
        codes = np.repeat(np.arange(len(sizes)), sizes)[met] * len(y) + at.drop_null().to_numpy()
        out |= np.isin(p.astype(np.int64) * len(y) + q, codes)
    return out


def _compared(names: DataFrame, least: float, edits: int) -> DataFrame:
    place = names.schema["ord"].dataType
    by_place = isinstance(place, StructType) and place.names == ["n", "name"]
    if not by_place and not isinstance(place, IntegralType):
        raise ValueError("names are ordered by whole numbers, or by (n, name)")
    ord_ = F.col("ord.n") if by_place else F.col("ord")
    extra = [c for c in ("apart", "gone") if c in names.columns]
    kind = place["n"].dataType.simpleString() if by_place else place.simpleString()

    def compare(one: pa.Table, two: pa.Table | None) -> Iterator[pa.Table]:
        one = one.sort_by("number").combine_chunks()
        two = two.sort_by("number").combine_chunks() if two else None
        other = two or one
        left, *right = _blocks(*(t["name"].to_pylist() for t in (one, two) if t))
        both = pa.concat_tables([t.select(["name", "ord"]) for t in (one, other)]).combine_chunks()
        rank = [(t["ord"].to_numpy(), t["number"].to_numpy()) for t in (one, other)]
        gone = [[pc.fill_null(pc.struct_field(t["gone"], c), 2**62).to_numpy() for c in ("oa", "ob")] for t in (one, other)] if "gone" in extra else []

        def table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
            i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int32)]) for k in (0, 1))
            if "apart" in extra and len(i):
                keep = ~_left_out(one, other, i, j)
                i, j = i[keep], j[keep]
            (ox, nx), (oy, ny) = ((o[k], n[k]) for (o, n), k in zip(rank, (i, j)))
            first = (ox < oy) | (ox == oy) & (nx < ny)
            if gone:
                oa, ob, keep = np.minimum(ox, oy), np.maximum(ox, oy), np.ones(len(i), bool)
                for (ga, gb), k in zip(gone, (i, j)):
                    keep &= (ga[k] > oa) | (ga[k] == oa) & (gb[k] > ob)
                i, j, first = i[keep], j[keep], first[keep]
            a, b = np.where(first, i, j + len(one)), np.where(first, j + len(one), i)
            return pa.table({"a": both["name"].take(a), "b": both["name"].take(b), "oa": both["ord"].take(a), "ob": both["ord"].take(b)})

        found, held = [], 0
        for p, a in enumerate(left):
            for b in right[0] if two else left[p:]:
                i, j = _open(a, b, least, edits)
                for k in range(0, len(i), PAIRS):
                    x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                    good = _alike_by_bits(a, b, x, y, least, edits)
                    found.append(((x[good] + a.at).astype(np.int32), (y[good] + b.at).astype(np.int32)))
                    held += len(found[-1][0])
                if held >= HELD:
                    yield table(found)
                    found, held = [], 0
        yield table(found)

    found = compare_stretches(names.where("name != ''").select("name", ord_.alias("ord"), *extra), ["name"], STRETCH, compare, f"a string, b string, oa {kind}, ob {kind}", most=LARGEST)
    back = lambda n: F.struct(F.col(f"o{n}").alias("n"), F.col(n).alias("name")) if by_place else F.col(f"o{n}")
    return found.select("a", "b", back("a").alias("oa"), back("b").alias("ob"))


def alike_by_winkler(names: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, oa, ob), oa < ob: names, each once, with a Jaro-Winkler similarity of `least` or more."""
    return _compared(names, least, -1)


def alike(names: DataFrame, jw_min: float = 0.85, lev_max: int = 2) -> DataFrame:
    """(a, b, oa, ob), oa < ob: names that are within lev_max edits, two at most, or alike by Jaro-Winkler. names: name, each once,
    and ord, a whole number or (n, name). Both are decided where two names meet, so no pair comes twice and none is shuffled.
    Pairs that aren't wanted are left out there, too: those of a name with the names in its `apart`, and, where names have a
    place `gone` (oa, ob), pairs at that place or after it."""
    if not 0 <= lev_max <= 2:
        raise ValueError("edit distances go up to two")
    return _compared(names, jw_min, lev_max)
