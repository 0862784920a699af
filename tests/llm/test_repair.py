"""Structure repair against plain versions: all edit sequences for short signatures, and whole conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from charloom.llm import repair

FORM = re.compile(r"(s?(ua)+)?")


def plain_edits(signs):
    """Cheapest edits by a search over whole prefixes, ties by the edits' order; nothing is shared or summed up."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, i, made = heapq.heappop(heap)
        if (i, made) in seen:
            continue
        seen.add((i, made))
        if i == len(signs) and FORM.fullmatch(made):
            return cost, edits
        turn = "u" if not made or made[-1] in "sa" else "a"
        if len(made) < len(signs) + 3:
            heapq.heappush(heap, (cost + 3, edits + "I", i, made + turn))
        if i < len(signs):
            sign = signs[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, made))
            if sign != "x":
                cut = 3 * sign.isupper()
                heapq.heappush(heap, (cost + 3 + cut, edits + "R", i + 1, made + turn))
                role = sign.lower()
                if role == turn or role == "s" and not made:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, made + role))


def plain(rows):
    """The contract's words for one table of (conv_id, turn, role, text), row by row."""
    out = []
    space = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = space(role), space(text)
            k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        counts, signs, seen = Counter(), "", set()
        for _, role, text in own:
            initial = role[:1] or " "
            sign = initial if initial in "sua" else "o"
            seen_chars = re.findall(r"[^\x20\x09-\x0D]", text)
            if not seen_chars:
                fault, sign = "blank", "x"
            elif (role, text) in seen:
                fault, sign = "duplicate", "x"
            elif seen_chars[-1] not in ".!?":
                fault, sign = "truncated", sign.upper()
            else:
                fault = "none"
            seen.add((role, text))
            counts[fault] += 1
            signs += sign
        initials = [r[1][:1] or " " for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = plain_edits(signs)
        lines, i, made = [], 0, ""
        for edit in audit:
            turn = "u" if not made or made[-1] in "sa" else "a"
            full = {"u": "user", "a": "assistant"}[turn]
            if edit == "I":
                lines.append(f"{full}:")
                made += turn
                continue
            _, role, text = own[i]
            i += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                made += role[0]
            elif edit == "R":
                lines.append(f"{full}:{text}")
                made += turn
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_search():
    rnd = random.Random(5)
    words = {""} | {"".join(rnd.choices(repair.SIGNS, k=rnd.randrange(1, 9))) for _ in range(1500)}
    trie = repair.Trie()
    for word in sorted(words):
        assert trie.solve(word) == plain_edits(word), word
    # layers are few, however many and long the signatures
    kinds = len(trie.layers.all)
    for word in sorted("".join(rnd.choices(repair.SIGNS, k=400)) for _ in range(200)):
        trie.solve(word)
    assert kinds <= len(trie.layers.all) < 200


def test_trie_any_order():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("uaUAx", k=rnd.randrange(0, 12))) for _ in range(300)]
    trie = repair.Trie()
    assert [trie.solve(w) for w in words] == [repair.Trie().solve(w) for w in words]


def test_long_signature():
    cost, audit = repair.Trie().solve("ua" * 50_000 + "u")
    assert (cost, audit) == (3, "K" * 100_001 + "I")


SCHEMA = "conv_id long, turn long, role string, text string, gaps string, audit int, kind string"


def odd_rows():
    rnd = random.Random(8)
    texts = [None, "", " \t\n", "Done.", "Done.", "cut off", "Really?  ", "No!\x0b", "naïve 中文。", "x.y", "🙂.", "line\nline two."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "assistant", "user", "s"]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), rnd.choice(roles[: 2 + conv % 9]), rnd.choice(texts) if conv % 3 else f"Turn {turn}."))
    rows += [(None, t, "user", "hello.") for t in range(4)] + [(None, None, None, None)] * 2
    rows += rows[:40]
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_equals_plain(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "g", 1, "k") for r in rows], SCHEMA).repartition(5)
    found = repair.repair(repair.damage(df))
    assert found.columns == [c.split()[0] for c in repair.REPAIRED.split(", ")]
    assert got(found) == plain(rows)


def test_empty(spark):
    assert got(repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)))) == []


def test_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 5, "assistant", "Hello."), (2, 0, "assistant", "Yes."), (3, 0, "system", "Be kind."), (3, 1, "user", "why")]
    found = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (found[1].audit, found[1].cost, found[1].gaps, found[1].duplicate, found[1].illegal) == ("KKD", 4, 3, 1, 1)
    assert (found[2].audit, found[2].cost) == ("IK", 3)
    assert (found[3].audit, found[3].cost, found[3].truncated) == ("KKI", 6, 1)


def test_query_equals_plain(spark, sf):
    base = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.query(spark, base)) == plain(rows)


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_inserted_roles(role):
    writer = repair._Writer("IIK" if role == "user" else "IK")
    assert writer.take(role, "t")[-1] == f"{role}:t"
