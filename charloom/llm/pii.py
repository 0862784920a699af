"""Personal data: fixed base patterns, and bootstrapped contextual extraction.

Bootstrapping: base matches are the seed entities. The words around a seed are its lexical patterns: the two before it, and the
one before with the one after. Spark scores the graph of patterns and instances over a few rounds: a pattern by the share of its
instances that are trusted, an instance by its best pattern. Every other word that stands in a pattern counts against it, so
patterns of plain prose are rejected. Patterns that reach `trust` with enough seeds then mark their other identifier-like
instances; those of e-mails mark words without digits too.

A null text is empty. Rows are told apart by id and text, so a repeated id's texts keep their own spans, equal rows get equal
spans, and a null doc_id is one like any other; an empty table gives no rows. Other columns are ignored, whatever they are called. Texts of any length are scanned whole, in
linear time; a word of a pattern that is longer than WORD_CHARS stands as a sign for any such word, and words further than REACH
characters from an entity aren't part of its patterns.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, save, table, texts

KINDS = ("email", "ip", "card", "phone")
LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]+")
SPACE_SIGNS = "\x20\t\n\x0b\x0c\r"
PART = LEFT - frozenset("%+") | frozenset("/")
#: Kinds whose instances need no digits.
NO_DIGITS = (0,)
SHORTEST = 6
#: Of words in patterns, and how far from an entity they are looked for.
WORD_CHARS, REACH = 60, 200
#: Patterns that are in a worker's memory at a time; more of them take further passes.
PATTERNS = 500_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outwards: its left part holds no @, so this is the leftmost match."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LEFT:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def identifiers(text: str) -> list[tuple[int, int]]:
    """Identifier-like words: 6 letters, digits and signs within or more, four digits at least. Looked for from each run of
    digits outwards, each to its own ends."""
    out, done = [], 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        a, b = _part_left(text, done, m.start()), PART_RUN.match(text, m.end()).end()
        done = b
        while text[a] in "./_-":
            a += 1
        while text[b - 1] in "./_-":
            b -= 1
        if b - a >= SHORTEST and len(DIGIT.findall(text, a, b)) >= 4:
            out.append((a, b))
    return out


def _part_left(text: str, least: int, at: int) -> int:
    while at > least and text[at - 1] in PART:
        at -= 1
    return at


PART_RUN = re.compile(r"[A-Za-z0-9._/-]*")


def _word(w: str) -> str:
    return DIGIT.sub("0", w.lower()) if len(w) <= WORD_CHARS else "~"


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around text[start:end], in small letters, digits as 0: the two words before, and the word before with the one
    after; "" stands for a word that isn't there."""
    at = max(0, start - REACH)
    near = [m for m in WORD.finditer(text, at, start)][-2:]
    # a word that the reach cuts counts as a long one
    left = ["~" if m.start() == at > 0 and text[at - 1] not in SPACE_SIGNS else _word(m[0]) for m in near]
    # what hangs on to the entity without white space is a word of its own, on either side
    after = WORD.search(text, end, end + REACH)
    right = ("~" if after.end() == end + REACH else _word(after[0])) if after else ""
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right}")
    return out


def instance(word: str) -> str:
    """An entity as a node of the graph: itself, or a digest of a long one."""
    return word if len(word) <= 64 else hashlib.sha1(word.encode("utf-8", "surrogatepass")).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string, seen array<struct<pattern:string,kind:int,instance:string,first:long,last:long>>"


def free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, in order and apart, that none of `taken` overlaps."""
    ends, out, at = sorted(taken), [], 0
    far = 0  # the furthest end of what starts before the span's end
    for a, b in spans:
        while at < len(ends) and ends[at][0] < b:
            far = max(far, ends[at][1])
            at += 1
        if far <= a:
            out.append((a, b))
    return out


def plain_words(text: str) -> list[tuple[int, int]]:
    """Words without the signs around them that are neither base matches nor identifiers."""
    words = []
    for m in WORD.finditer(text):
        a, b = m.span()
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            words.append((a, b))
    return free(words, [(a, b) for _, a, b in base_spans(text)] + identifiers(text))


ZEROS = str.maketrans("123456789", "000000000")


def in_patterns(text: str, patterns, lasts: LastWords):
    """(pattern, start, end) of the plain words that stand in one of the patterns. Only a word that may be in one, by the words
    next to it, is looked at closely."""
    small = WORD.findall(text.lower().translate(ZEROS))
    if lasts.keys().isdisjoint(small) and not any(w in text for w in lasts.signs) and ("~" not in lasts or len(text) <= WORD_CHARS):
        return
    places = [m.span() for m in WORD.finditer(text)]
    if len(text) > WORD_CHARS:
        small = [w if b - a <= WORD_CHARS else "~" for w, (a, b) in zip(small, places)]
    found, end, known = [], len(places), lasts.get
    for i, (first, last) in enumerate(places):
        a, b = first, last
        if text[a].isalnum():
            # most words end here
            if not i:
                continue
            near = known(small[i - 1])
            if near is None and first - places[i - 1][1] <= REACH // 2:
                continue
        else:
            while a < last and not text[a].isalnum():
                a += 1
            if a == last or (near := known(_word(text[first:a]))) is None:
                continue
        while not text[b - 1].isalnum():
            b -= 1
        # signs that hang on to the word are words of their own
        k = i - 2 if a == first else i - 1
        cut = near is None or places[max(k, 0)][0] < a - REACH or (i + 1 < end and places[i + 1][1] >= b + REACH if b == last else last - b >= REACH)
        if cut or k >= 0 and small[k] in near[0] or (_word(text[b:last]) if b < last else small[i + 1] if i + 1 < end else "") in near[1]:
            found += [(c, a, b) for c in contexts(text, a, b) if c in patterns]
    if found:
        taken = [(a, b) for _, a, b in base_spans(text)] + identifiers(text)
        plain = set(free(sorted({(a, b) for _, a, b in found}), taken))
        yield from (x for x in found if x[1:] in plain)


class LastWords(dict):
    """For each word before an entity in one of the patterns, the words before it and the words after the entity; signs are those
    that can hang on to an entity."""

    def __init__(self, patterns):
        for c in patterns:
            one, two, three = c.split(" ")
            if three == "_":
                self.setdefault(two, (set(), set()))[0].add(one)
            if two == "_":
                self.setdefault(one, (set(), set()))[1].add(three)
        self.signs = {w for w in self if w != "~" and not any(x.isalnum() for x in w)}


def numbered(docs: DataFrame) -> DataFrame:
    """The texts with `row`, a hash of id and text."""
    return texts(docs).select(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text").alias("row"), "doc_id", "text")


def base_scan(rows: DataFrame) -> DataFrame:
    """Base spans of each row, and its entities in their patterns: seeds (with their kind) and other identifier-like words (-1)."""

    def work():
        def each(row, doc_id, text):
            spans = base_spans(text)
            seen = []
            if spans or DIGIT.search(text):
                others = free(identifiers(text), [(a, b) for _, a, b in spans])
                for k, a, b in [*spans, *((-1, a, b) for a, b in others)]:
                    seen += [{"pattern": c, "kind": k, "instance": instance(text[a:b]), "first": a, "last": b} for c in contexts(text, a, b)]
            n = [sum(s[0] == k for s in spans) for k in range(4)]
            yield row, doc_id, *n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans), seen

        return each

    return map_rows(rows, work, FOUND)


def slices(patterns: DataFrame, *columns: str):
    """The rows of a table of patterns, as lists of about PATTERNS: all of them at once, or by hash, one after the other."""
    n = patterns.count()
    k = max(1, -(-n // PATTERNS))
    for i in range(k if n else 0):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(k)) == i) if k > 1 else patterns
        yield [tuple(r) for r in part.select("pattern", *columns).collect()]


def count_plain(rows: DataFrame, hopeful: dict[str, int], trust: float) -> DataFrame:
    """(pattern, others): how many different plain words stand in each of the hopeful patterns. A task stops to collect a
    pattern's words once they are too many for any score of `trust`, so few rows are sent."""
    most, lasts = {c: int(n / trust - n) + 1 for c, n in hopeful.items()}, LastWords(hopeful)

    def work():
        words: dict[str, set[str]] = {}

        def each(row, doc_id, text):
            for c, a, b in in_patterns(text, most, lasts):
                held = words.setdefault(c, set())
                if len(held) <= most[c]:
                    held.add(_word(text[a:b]))
            return ()

        each.finish = lambda: [(c, w) for c, held in words.items() for w in held]
        return each

    return map_rows(rows, work, "pattern string, word string").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("others"))


def mark_plain(rows: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """Plain words of an identifier's length in trusted patterns whose kind needs no digits."""
    lasts = LastWords(kinds)

    def work():
        def each(row, doc_id, text):
            for c, a, b in in_patterns(text, kinds, lasts):
                if SHORTEST <= b - a and PART.issuperset(text[a:b]):
                    yield row, doc_id, kinds[c], a, b

        return each

    return map_rows(rows, work, "row long, doc_id long, kind int, first long, last long")


def trusted_patterns(seen: DataFrame, rows: DataFrame, rounds: int = 3, trust: float = 0.6, least_seeds: int = 5) -> DataFrame:
    """(pattern, kind) of the patterns that the rounds trust. seen: (pattern, kind, instance), kind -1 for unknown ones.
    Edges are counted before anything is joined, so a hot pattern costs one row per distinct instance. The other words in
    patterns of at least `least_seeds` different entities are counted in passes over the texts; other patterns can't reach that
    mass, and those without a seed can't begin to."""
    every = seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    many = every.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("k")).where(F.col("n") >= least_seeds)
    edges = save(every.join(many.select("pattern"), "pattern", "left_semi"), "pii-edges")
    hopeful = save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pii-hopeful")
    others = None
    for part in slices(hopeful, "n"):
        found = save(count_plain(rows, dict(part), trust), "pii-others")
        others = found if others is None else others.unionByName(found)
    belief = edges.select("instance", "kind").where("kind >= 0").groupBy("instance").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("belief"))
    patterns = None
    for _ in range(rounds if others is not None else 0):
        # by pattern and kind: how much belief its instances have, and how many they are
        by_kind = edges.select("pattern", "instance").join(belief, "instance", "left").groupBy("pattern", "kind").agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("mass"), F.count(F.lit(1)).alias("n"))
        best = by_kind.groupBy("pattern").agg(F.max_by(F.when(F.col("kind").isNotNull(), F.struct("kind", "mass")), F.struct(F.coalesce("mass", F.lit(0.0)), -F.coalesce("kind", F.lit(9)))).alias("b"), F.sum("n").alias("n"))
        best = best.join(others, "pattern", "left").withColumn("n", F.col("n") + F.coalesce("others", F.lit(0)))
        scored = best.where("b is not null").select("pattern", F.col("b.kind").alias("kind"), (F.col("b.mass") / F.col("n")).alias("score"), F.col("b.mass").alias("mass"))
        last, patterns = patterns, save(scored.where((F.col("score") >= trust) & (F.col("mass") >= least_seeds)), "pii-patterns")
        if patterns.isEmpty() or last is not None and patterns.select("pattern", "kind", "score").exceptAll(last.select("pattern", "kind", "score")).isEmpty():
            break
        grown = edges.join(patterns.select("pattern", F.col("kind").alias("pkind"), "score"), "pattern")
        grown = grown.groupBy("instance").agg(F.max_by("pkind", F.struct("score", -F.col("pkind"))).alias("kind"), F.max(F.when(F.col("kind") >= 0, F.lit(1.0)).otherwise(F.col("score"))).alias("belief"))
        belief = save(grown.unionByName(belief.select("instance", "kind", "belief")).groupBy("instance").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"), F.max("belief").alias("belief")), "pii-belief")
    return patterns.select("pattern", "kind") if patterns is not None else rows.sparkSession.createDataFrame([], "pattern string, kind int")


def find_private(docs: DataFrame) -> DataFrame:
    rows = numbered(docs)
    found = save(base_scan(rows), "pii-base")
    seen = found.select("row", "doc_id", F.explode("seen").alias("s")).select("row", "doc_id", "s.*")
    patterns = trusted_patterns(seen.select("pattern", "kind", "instance"), rows)
    more = seen.where("kind < 0").drop("kind").join(patterns, "pattern").select("row", "doc_id", "kind", "first", "last")
    for part in slices(patterns.where(F.col("kind").isin(*NO_DIGITS)), "kind"):
        more = more.unionByName(save(mark_plain(rows, dict(part)), "pii-plain"))
    more = more.groupBy("row", "doc_id", "first", "last").agg(F.min("kind").alias("kind"))
    more = more.groupBy("row", F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("kind", "first", "last"))).alias("more"))
    added = F.transform("more", lambda m: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1), m["first"], m["last"]))
    both = F.array_sort(F.concat(F.filter(F.split("base_spans", ","), lambda s: s != ""), added), _by_kind_and_start)
    out = found.drop("seen").join(more.withColumnRenamed("row", "_row"), (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("more").isNull(), F.col("base_spans")).otherwise(F.array_join(both, ",")).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_more"))


def _by_kind_and_start(a, b):
    key = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]), F.split(s, ":")[1].cast("long"), F.split(s, ":")[2].cast("long"))
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
