"""Secret scans: fixed base patterns, and a novelty measure that finds further secrets.

Novelty: a long token near a sensitive word is compressed by zstandard after its surroundings and a dictionary of identifiers;
where the token adds nearly as many bytes as it has, nothing before it tells what it is, and it is reported. The dictionary has
common identifiers and, from a count over all documents, the DICTIONARY_WORDS most frequent identifiers around sensitive words
(`learn_identifiers`). A sensitive word may be part of an identifier (AWS_SECRET_ACCESS_KEY). A token starts within REACH
characters after the word, or ends within REACH characters before it, and runs to its own end, however long.

A null text is empty. Rows are scanned one by one, so repeated rows and ids, null ids and ties need no rule; identifiers of equal
counts go by name. An empty table gives no rows. Other columns are ignored, whatever they are called. Texts of any length are
scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, map_rows, table, texts, trim

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|bearer|auth(?:orization)?|signature)(?![a-z0-9])", re.ASCII)
SHORTEST = 16
#: A token: parts of at least SHORTEST signs, joined by dots as in signed web tokens.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}(?:\.[A-Za-z0-9+/_=-]{%d,})*" % (SHORTEST, SHORTEST))
SIGN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
SIGNS = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Dictionary of common identifiers that secrets are compared with.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credentials bearer authorization signature "
    "client_id client_secret session_id user_id username account_id request_id timestamp configuration environment "
    "application connection database hostname localhost index value string number integer boolean function return "
    "public private static const import export default undefined example test sample placeholder changeme your-key-here "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0000000000 xxxxxxxxxxxxxxxx"
).encode()
#: Fixed bound of the counted part of the dictionary.
DICTIONARY_WORDS = 2000
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_]{2,39}")
REACH = 48
AROUND = 256
LEAST = 0.7
#: A token is judged by its first HEAD characters too; whole once per run of its signs, so the work stays linear.
HEAD = REACH + 512


def learn_identifiers(docs: DataFrame) -> bytes:
    """The dictionary for docs: IDENTIFIERS after the most frequent words of letters and underscores within AROUND characters of
    sensitive words. A word counts once a document, and digits are no part of one, so a secret that is copied about hardly gets
    in. Tasks count before anything is sent, and the driver gets DICTIONARY_WORDS words."""

    def work():
        counts: dict[str, int] = {}

        def flush():
            out = list(counts.items())
            counts.clear()
            return out

        def each(doc_id, text):
            at, found = 0, set()
            for m in SENSITIVE.finditer(text):
                found.update(IDENTIFIER.findall(text, max(at, m.start() - AROUND), at := min(len(text), m.end() + AROUND)))
            for w in found:
                counts[w] = counts.get(w, 0) + 1
            return flush() if len(counts) > 100_000 else ()

        each.finish = flush
        return each

    counted = map_rows(texts(docs), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()]
    # the most frequent ones last, where zstandard has the shortest way to them
    return " ".join(reversed(top)).encode() + b" " + IDENTIFIERS


class Novelty:
    def __init__(self, identifiers: bytes = IDENTIFIERS):
        import zstandard

        kind = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(level=9)
        self.size = lambda b, c=zstandard.ZstdCompressor(level=9, dict_data=kind, write_content_size=False, write_checksum=False): len(c.compress(b))

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes that the token adds to its surroundings, over its length."""
        around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).encode("utf-8", "surrogatepass")
        token = text[start:end].encode()
        return (self.size(around + b"\n" + token) - self.size(around + b"\n")) / len(token)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    if "=" in text or ":" in text:
        # without : or = nothing can match; IGNORECASE is held to ASCII letters by re.ASCII
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run either passes or fails as a whole
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def mixed(token: str) -> bool:
    return len(set(token)) >= 8 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def _start(text: str, least: int, at: int) -> int:
    """Where the token begins whose last part's signs go on to the left of `at`, not before `least`."""
    while True:
        end = at
        while at > least and text[at - 1] in SIGN:
            at -= 1
        while end < len(text) and text[end] in SIGN and end - at < SHORTEST:
            end += 1
        part = at - 1
        while part > least and text[at - 1] == "." and text[part - 1] in SIGN:
            part -= 1
        if end - at < SHORTEST or at - 1 - part < SHORTEST or text[at - 1] != ".":
            return at
        at = part


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    """Tokens near a sensitive word that no base span covers and that nothing around them foretells. Of tokens within each other
    the longest counts."""
    out: dict[int, int] = {}  # start by end: a run of token signs has one end
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    judged: set[int] = set()
    first = last = 0  # the run looked at last

    def judge(start: int, end: int, whole: bool) -> None:
        before = bisect_right(starts, start)  # base spans that start no later than the token
        if end in out or start in judged or before and reach[before - 1] >= end:
            return
        judged.add(start)
        head = min(end, start + HEAD)
        if any(mixed(text[start:e]) and novelty(text, start, e) >= LEAST for e in ((head, end) if whole and head < end else (head,))):
            out[end] = start

    back = 0  # tokens that end before here have been looked for
    for s in SENSITIVE.finditer(text):
        # runs that end within REACH before the word, from their own start
        at = max(back, s.start() - REACH)
        for m in SIGNS.finditer(text, at, s.start()):
            a, b = m.span()
            if b == s.start() or a < last:
                continue  # it goes on into the word, or the runs after the last word had it
            a = _start(text, back, a)
            if token := TOKEN.match(text, a, s.start()):
                last = token.end()
                judge(a, last, True)
        back = s.end()
        # as far as shows the least of a token that starts at REACH; its end is looked for apart
        for m in TOKEN.finditer(text, s.end(), s.end() + REACH + SHORTEST):
            start = m.start()
            whole = not first <= start < last
            if whole:
                first, last = start, TOKEN.match(text, start).end()
            judge(start, last, whole)
    return sorted((a, b) for b, a in out.items())


def find(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end); kind 3 is novelty."""
    base = base_spans(text)
    found = novel_spans(text, base, novelty) if SENSITIVE.search(text) else []
    return base, sorted([*base, *((a, 3, b) for a, b in found)])


def joined(spans) -> str:
    names = (*KINDS, "novel")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame) -> DataFrame:
    dictionary = learn_identifiers(docs)

    def work():
        novelty = Novelty(dictionary)

        def each(doc_id, text):
            base, every = find(text, novelty)
            n = [sum(s[1] == k for s in every) for k in range(4)]
            yield doc_id, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n[3]

        return each

    return map_rows(texts(docs), work, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with the mask in place of the spans; overlapping ones are masked as one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """docs with every secret in `text` replaced by the mask, and n_chars, where there is one, set to the new length. Documents
    without secrets stay as they are, a null text too."""
    fields, names, dictionary = docs.schema, docs.columns, learn_identifiers(docs)

    def run(batches):
        import pyarrow as pa

        lean()
        novelty = Novelty(dictionary)
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(names)}
            new = cols["text"].to_pylist()
            length = cols["n_chars"].to_pylist() if "n_chars" in cols else None
            for i, text in enumerate(new):
                if text and (spans := find(text, novelty)[1]):
                    new[i] = masked(text, spans, mask)
                    if length:
                        length[i] = len(new[i])
            cols["text"] = pa.array(new, type=cols["text"].type)
            if length:
                cols["n_chars"] = pa.array(length, type=cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema)
        trim()

    return docs.mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
