"""Conversation structure repair: the cheapest edits that give a conversation's turns the form (system? (user assistant)+)?.

Each row has a role and at most one fault, so a conversation is a word over few signs, its signature. Sorted signatures form a
prefix trie: a task walks it with the layers of the path it is on, so a shared prefix's layers are worked out once, and at each
terminal node reads off that signature's edits. Edits come back to their conversations by signature.

A layer holds, for each state that the repaired turns may be in, the least cost so far, and the states' order by their edits.
Edits that end in different states first differ within the rows read, so that order decides all later ties, and a layer follows
from the one before it and the next sign alone.

Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. Null roles and texts are one space, a null
conv_id is a conversation of its own and a null conv_id or turn is one space to damage(). A role's initial is its first character, of
an empty role one space; initials other than s, u and a are never kept. Repeated rows are duplicates. A conversation whose rows are all
gone has zeros. An empty table gives no rows. Other columns are ignored, whatever they are called. Texts are streamed in sorted
order and never held; of a conversation's rows a task holds a few bytes each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, _batch, lean, save, table, trim

#: White space, as in the contracts of words.
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States of the repaired turns: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that a user or assistant turn leads to.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Signs of a signature: the initial for a sound row, its capital for a truncated one, o and O for other roles, x for a blank or duplicate.
SIGNS = "suaoSUAOx"


def _kept(state: int, role: str) -> int | None:
    """The state after a kept row, or None where it can't stand."""
    if role == "s":
        return SYSTEM if state == START else None
    turn = TURN[state]
    return turn if role in "ua" and ROLE[turn][0] == role else None


class Layers:
    """The DP's layers, each known by a number; a layer's costs count from its least one, so there are few of them."""

    def __init__(self):
        #: (cost, place) of each state that can be reached; places order the states by their edits.
        self.all: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.next: dict[tuple[int, str], tuple[int, int, int]] = {}
        #: For each state, the state before and the edits since.
        self.steps: list[tuple] = []
        self.step_number: dict[tuple, int] = {}
        self.first = self._intern(((0, 0), None, None, None))

    def _intern(self, layer: tuple) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.all)
            self.all.append(layer)
        return self.number[layer]

    @staticmethod
    def _inserts(state: int) -> list[tuple[int, int, str]]:
        """(state, cost, edits) after up to two inserted turns; more would only come back to the same states."""
        out = [(state, 0, "")]
        for k in (1, 2):
            state = TURN[state]
            out.append((state, k * INSERT, "I" * k))
        return out

    def after(self, layer: int, sign: str) -> tuple[int, int, int]:
        """The layer after a row with this sign, what the least cost rises by, and the number of its steps."""
        if (layer, sign) in self.next:
            return self.next[layer, sign]
        role, cut = sign.lower(), CUT * sign.isupper()
        best: list[tuple | None] = [None] * 4
        for before, known in enumerate(self.all[layer]):
            if known is None:
                continue
            cost, place = known
            for state, more, edits in self._inserts(before):
                ways = [(state, DELETE, "D")]
                if sign != "x":
                    ways.append((TURN[state], REROLE + cut, "R"))
                    if (kept := _kept(state, role)) is not None:
                        ways.append((kept, cut, "K"))
                for end, price, edit in ways:
                    found = (cost + more + price, place, edits + edit, before)
                    if best[end] is None or found < best[end]:
                        best[end] = found
        # whatever follows costs no more after an assistant turn, but for a system turn, which can be deleted
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if best[state] and best[state][0] > best[ASSISTANT][0] + more:
                best[state] = None
        least = min(b[0] for b in best if b)
        order = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        made = self._intern(tuple(b and (b[0] - least, order[b[1:]]) for b in best))
        steps = tuple(b and (b[3], b[2]) for b in best)
        self.step_number.setdefault(steps, len(self.steps))
        if self.step_number[steps] == len(self.steps):
            self.steps.append(steps)
        self.next[layer, sign] = made, least, self.step_number[steps]
        return self.next[layer, sign]

    def end(self, layer: int) -> tuple[int, int, str]:
        """The state that the best edits are in, what they cost above the least, and the turns inserted after the last row."""
        found = min((known[0] + more, known[1], edits, state) for state, known in enumerate(self.all[layer]) if known is not None for end, more, edits in self._inserts(state) if end in (START, ASSISTANT))
        return found[3], found[0], found[2]


class Trie:
    """Walks sorted signatures as the paths of a prefix trie, keeping the layers of the current path."""

    def __init__(self):
        self.layers = Layers()
        self.path, self.at, self.cost, self.step = "", array("l", [self.layers.first]), array("q", [0]), array("l", [0])

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature."""
        shared, most = 0, min(len(signature), len(self.path))
        if signature[:most] == self.path[:most]:
            shared = most
        else:
            low, high = 0, most  # prefixes of low signs are equal, those of high aren't
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if signature[:middle] == self.path[:middle] else (low, middle)
            shared = low
        for column in (self.at, self.cost, self.step):
            del column[shared + 1 :]
        for sign in signature[shared:]:
            layer, more, step = self.layers.after(self.at[-1], sign)
            self.at.append(layer)
            self.cost.append(self.cost[-1] + more)
            self.step.append(step)
        self.path = signature
        state, more, tail = self.layers.end(self.at[-1])
        edits = [tail]
        for i in range(len(signature), 0, -1):
            state, part = self.layers.steps[self.step[i]][state]
            edits.append(part)
        return self.cost[-1] + more, "".join(reversed(edits))


def damage(turns: DataFrame) -> DataFrame:
    """Damages rows by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes .!? from it, 3 repeats it, 4 makes
    its role user. A dropped row stays as the mark of its conversation, with `gone`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("k", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy"), (F.col("k") == 0).alias("gone"))


def _marked(rows: DataFrame) -> DataFrame:
    """Without texts: conv_id, turn, role, digest of the text, gone, and kind: b blank, c truncated, s sound."""
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    kind = F.when(last == "", "b").when(last.isin(".", "!", "?"), "s").otherwise("c")
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "gone", kind.alias("kind"))


SUMMARY = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: its signature and the counts of its faults. Rows: conv_id, turn, role, text and, if they are to
    leave only their conversation, gone."""
    fields = _arrow_schema(rows.sparkSession, SUMMARY)
    # a duplicate comes after an equal row, wherever that is
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("gone", "turn"))
    seen = _marked(rows).withColumn("again", ~F.col("gone") & (earlier > 1))
    ordered = seen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        out: list[tuple] = []
        conv, begun, one = None, False, None
        for batch in batches:
            for conv_id, turn, role, gone, kind, again in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "gone", "kind", "again"))):
                if not begun or conv_id != conv:
                    if one:
                        out.append(one.row(conv))
                    conv, begun, one = conv_id, True, _Faults()
                if not gone:
                    one.add(turn, role, kind, again)
            if len(out) >= 1000:
                yield _batch(out, fields)
                out = []
        if one:
            out.append(one.row(conv))
        if out:
            yield _batch(out, fields)
        trim()

    return ordered.mapInArrow(run, SUMMARY)


class _Faults:
    """What a conversation's rows in order come to."""

    def __init__(self):
        self.signs, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.low = self.high = None
        self.turns, self.before = 0, None

    def add(self, turn: int | None, role: str, kind: str, again: bool) -> None:
        initial = role[:1] or " "
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        sign = initial if initial in "sua" else "o"
        if kind == "b":
            self.blank += 1
            sign = "x"
        elif again:
            self.duplicate += 1
            sign = "x"
        elif kind == "c":
            self.truncated += 1
            sign = sign.upper()
        self.signs += sign.encode()

    def row(self, conv: int | None) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, self.signs.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


ANSWER = "signature string, cost long, audit string"


def solve(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures: each task has an interval of the sorted ones and walks their trie."""
    fields = _arrow_schema(found.sparkSession, ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        trie, out, size = Trie(), [], 0
        for batch in batches:
            for signature in batch["signature"].to_pylist():
                out.append((signature, *trie.solve(signature)))
                size += len(signature)
                if len(out) >= 2000 or size >= 2_000_000:
                    yield _batch(out, fields)
                    out, size = [], 0
        if out:
            yield _batch(out, fields)
        trim()

    return found.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, ANSWER)


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Writer:
    """Applies a conversation's edits to its rows as they come; gives the repaired turns' role:text lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> list[str]:
        lines = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = TURN[self.state], self.at + 1
            lines.append(f"{ROLE[self.state]}:")
        return lines

    def take(self, role: str, text: str) -> list[str]:
        lines = self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return lines
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else TURN[self.state]
        return [*lines, f"{role if edit == 'K' else ROLE[self.state]}:{text}"]

    def rest(self) -> list[str]:
        return self._inserted()


def apply(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (a row per conversation with its audit) and the SHA-256 of the repaired turns, which are streamed in order."""
    fields = _arrow_schema(rows.sparkSession, REPAIRED)
    rows = rows.where("not gone") if "gone" in rows.columns else rows
    own = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = answers.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("text"), *own)
    body = rows.select("conv_id", F.lit(1).alias("after"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", *(F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in own))
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "digest").drop("digest", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        out: list[tuple] = []
        head, writer, hashed, any_line = None, None, None, False

        def put(lines: list[str]) -> None:
            nonlocal any_line
            for line in lines:
                hashed.update((f"\n{line}" if any_line else line).encode("utf-8", "surrogatepass"))
                any_line = True

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for conv_id, after, role, text, *rest in zip(*(c.to_pylist() for c in part.columns)):
                    if not after:
                        if head:
                            put(writer.rest())
                            out.append((*head, hashed.hexdigest()))
                        head, writer, hashed, any_line = (conv_id, *rest), _Writer(rest[-1]), hashlib.sha256(), False
                    else:
                        put(writer.take(role, text))
                if len(out) >= 1000:
                    yield _batch(out, fields)
                    out = []
        if head:
            put(writer.rest())
            out.append((*head, hashed.hexdigest()))
        if out:
            yield _batch(out, fields)
        trim()

    return ordered.mapInArrow(run, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, the cheapest edits and the repaired turns' digest of each conversation. Rows as damage() gives them."""
    found = save(signatures(rows), "signatures")
    answers = found.join(solve(found), "signature").drop("signature")
    return apply(rows, answers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
