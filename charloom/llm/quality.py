"""Quality rules as a short-circuit cascade.

Every document gets the base measures of its whole text. Documents that pass the base rules go through further rules, one
after the other until one rejects. The order costs time only and never changes a verdict: it is set from a sample of about
`sample_rows` documents, greedily by rejections per second among what earlier rules have left.

Nulls and empty texts have no words and fail the base rules. Repeated rows are judged row by row; repeated ids and null ids
need no rule. Other columns are ignored, whatever they are called. An empty table gives no rows, and any order.
"""

from __future__ import annotations

import logging
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, map_rows, table, texts, trim

SYMBOLS = b"#*$%&|<>"
SPACES = bytes([0x20, 9, 10, 11, 12, 13])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words that occurs twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=len(words))
    if len(seen) == len(words):
        return 0
    if len(seen) < 7000:  # five ids of fewer than 13 bits: the key is exact
        key = ids[:n].copy()
        base = np.uint64(len(seen))
        for k in range(1, 5):
            key *= base
            key += ids[k : n + k]
    else:  # exact too: pairs of ids are numbered anew at each step
        key = ids[:n]
        for k in range(1, 5):
            key = np.unique(key * np.uint64(len(seen) + 1) + ids[k : n + k], return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(5):
        inside[k : n + k] |= twice
    return int(inside.sum())


def base_measures(text: str) -> tuple[list[bytes], dict]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line.strip(SPACES):
                if line in lines:
                    dup += 1
                else:
                    lines.add(line)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return words, {
        "n_words": len(words),
        "word_chars": len(text) - spaces,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words),
        "raw": raw,
    }


def symbol_share(words, m) -> bool:
    """More than one symbol for every 20 word characters, besides single ones."""
    return m["n_symbols"] > 3 and 20 * m["n_symbols"] > m["word_chars"]


def shouting(words, m) -> bool:
    """More ASCII capitals than small letters."""
    raw = m["raw"]
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return capitals > small and capitals > 20


def dup_lines(words, m) -> bool:
    """More than three in ten lines repeat an earlier one."""
    return m["n_dup_lines"] > 2 and 10 * m["n_dup_lines"] > 3 * (m["raw"].count(b"\n") + 1)


def word_length(words, m) -> bool:
    """Words of fewer than two or more than 20 characters on average."""
    return not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]


def few_words(words, m) -> bool:
    """Fewer distinct words than the square root of the number of words."""
    return len(words) >= 50 and len(set(words)) ** 2 < len(words)


def stutter(words, m) -> bool:
    """Every fourth word or more is the one before again."""
    return len(words) >= 8 and 4 * sum(a == b for a, b in zip(words, words[1:])) >= len(words)


def bars(words, m) -> bool:
    """Every fourth word or more is a lone separator sign."""
    return 4 * sum(map(words.count, (b"|", b"-", b"*", b">", b"<", b"#"))) >= len(words)


def no_letters(words, m) -> bool:
    """Fewer than half of the word bytes are letters or beyond ASCII."""
    raw = m["raw"]
    letters = len(raw) - len(raw.translate(None, bytes([*range(65, 91), *range(97, 123), *range(128, 256)])))
    return 2 * letters < m["word_chars"]


def exclamations(words, m) -> bool:
    """Exclamation or question marks after every third word or more."""
    return 3 * (m["raw"].count(b"!") + m["raw"].count(b"?")) > len(words)


RULES = {f.__name__: f for f in (symbol_share, shouting, dup_lines, word_length, few_words, stutter, bars, no_letters, exclamations)}


def base_failed(m: dict) -> bool:
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def rule_costs(docs: DataFrame, sample_rows: int = 500, seed: int = 42) -> tuple[dict[str, int], dict[int, int]]:
    """On a sample of about sample_rows documents, those whose doc_id has a small hash: nanoseconds of each rule, and of the
    documents that pass the base rules how many each combination of rejecting rules has (bits by the rules' names in order).
    Each task hands back at most a row per rule and combination, so the driver gets a few numbers only, whatever the input."""
    names = sorted(RULES)
    total = docs.count()
    if not total:
        return {}, {}

    def work():
        spent, seen = [0] * len(names), {}

        def each(doc_id, text):
            words, m = base_measures(text)
            if not base_failed(m):
                bits = 0
                for k, r in enumerate(names):
                    t = time.thread_time_ns()
                    bits |= bool(RULES[r](words, m)) << k
                    spent[k] += time.thread_time_ns() - t
                seen[bits] = seen.get(bits, 0) + 1
            return ()

        each.finish = lambda: [(k, None, ns) for k, ns in enumerate(spent)] + [(None, bits, n) for bits, n in seen.items()]
        return each

    bound = min(1 << 30, -(-(1 << 30) * sample_rows // total))
    sample = texts(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < bound)
    found = map_rows(sample, work, "rule int, bits int, n long").groupBy("rule", "bits").agg(F.sum("n").alias("n")).collect()
    return {names[r.rule]: r.n for r in found if r.rule is not None}, {r.bits: r.n for r in found if r.bits is not None}


def order_by(costs: dict[str, int], outcomes: dict[int, int]) -> list[str]:
    """Rules by what they reject per second of the documents that the rules before them have left; ties by name."""
    names, left, out = sorted(RULES), dict(outcomes), []
    while len(out) < len(names):
        rejected = {r: sum(n for bits, n in left.items() if bits >> k & 1) for k, r in enumerate(names) if r not in out}
        best = min(rejected, key=lambda r: (-(rejected[r] + 0.5) / (costs.get(r, 0) + 1), r))
        left = {bits: n for bits, n in left.items() if not bits >> names.index(best) & 1}
        out.append(best)
    return out


def rule_order(docs: DataFrame, sample_rows: int = 500) -> list[str]:
    """The cascade's order, from the sample. It hangs on times measured, so it is logged; verdicts don't hang on it."""
    costs, outcomes = rule_costs(docs, sample_rows)
    order = order_by(costs, outcomes)
    logging.getLogger(__name__).info("order of rules %s; nanoseconds %s; rejections by rules %s", order, costs, outcomes)
    return order


def quality_verdicts(docs: DataFrame, sample_rows: int = 500) -> DataFrame:
    """A row per document: base measures, whether the base rules failed, the verdict, and the rule that rejected."""
    order = rule_order(docs, sample_rows)

    def work():
        def each(doc_id, text):
            words, m = base_measures(text)
            failed = base_failed(m)
            rule = "base" if failed else next((r for r in order if RULES[r](words, m)), None)
            yield doc_id, m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, rule is None, rule

        return each

    return map_rows(texts(docs), work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rejecting rule depends on the order where several reject, so it is left out
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("failed_rule")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    order = rule_order(docs)
    fields = docs.schema
    at = fields.names.index("text")

    def run(batches):
        import pyarrow as pa

        lean()
        for batch in batches:
            mask = []
            for text in batch.column(at).to_pylist():
                words, m = base_measures(text or "")
                mask.append(not base_failed(m) and not any(RULES[r](words, m) for r in order))
            yield batch.filter(pa.array(mask, type=pa.bool_()))
        trim()

    return docs.mapInArrow(run, fields)
