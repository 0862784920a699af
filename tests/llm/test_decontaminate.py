"""Template decontamination: copies, re-parameterised questions, and what must be left alone."""

import random
import re

from charloom.llm import decontaminate as d

ITEM = "A train leaves the town at noon and travels 120 km to the east before Anna boards it with 3 bags and 2 boxes of fruit."


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.contaminated(docs, bench).collect()}, docs, bench


def test_templates(spark):
    copy = "Some words first. " + ITEM + " And more."
    other = ITEM.replace("120 km", "75 miles").replace("Anna", "Boris").replace("3 bags", "9 bags")
    torn = ITEM.replace("3 bags", "120 bags").replace("120 km", "75 km")  # 120 and 75 stand for different values at different places
    alike = ITEM.replace("3 bags", "5 bags").replace("2 boxes", "5 boxes")  # two values may become one
    loud = " ".join(w + "!!" for w in ITEM.upper().split())
    part = " ".join(ITEM.split()[:9])
    got, docs, bench = found(spark, [copy, other, torn, alike, loud, part, None, "", "unrelated words " * 50, copy])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 0)}
    assert got[0, 0].same_slots and not got[1, 0].same_slots and got[0, 0].longest_run == got[0, 0].item_tokens
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [5, 6, 7, 8]
    assert d.clean(docs, bench).columns == docs.columns


def test_slots_count_within_their_run(spark):
    """What differs behind a changed passage doesn't undo a verbatim run before it."""
    first = "A train leaves the town at noon and travels 7 km to the east before Anna boards it with her bags and boxes."
    last = "Then the driver walks slowly back for 7 minutes along the old road towards the quiet station."
    item = first + " Nobody had seen such weather. " + last
    doc = first + " It rained and rained over. " + last.replace("7", "9")
    got, docs, bench = found(spark, [doc, item], (item,))
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].longest_run >= 20 and not got[0, 0].same_slots and got[1, 0].same_slots
    assert got[1, 0].longest_run == got[1, 0].covered == got[1, 0].item_tokens
    assert d.clean(docs, bench).count() == 0


def test_empty_and_short(spark):
    assert not found(spark, ["few words"], ("few words",))[0]
    got, docs, bench = found(spark, [ITEM])
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0


def plain_tokens(text):
    """(token, code) pairs: what the docstring of the module says, written plainly."""
    raw = [t for t in re.split(r"[^\w.!?]+|_+", text or "") if t and t[0] not in ".!?"]
    out = []
    for k, t in enumerate(raw):
        word, before = t.rstrip(".!?"), raw[k - 1] if k else ""
        if "0" <= t[0] <= "9":
            code = "#"
        elif "A" <= t[0] <= "Z" and k and before[-1] not in ".!?" and t != t.upper():
            code = "@"
        elif k and "0" <= before[0] <= "9" and word.lower() in d.UNITS:
            code = "%"
        else:
            code = word.lower()
        out.append((word, code))
    return out


def plain_hits(text, item):
    """Whether the text holds the item, by all shifts of one against the other."""
    a, b = plain_tokens(text), plain_tokens(item)
    if len(b) < d.SHORT:
        return False
    width = min(d.WINDOW, len(b))
    for shift in range(-len(b), len(a)):
        at, last, slots = None, None, {}
        for k in range(len(b) - width + 1):
            x, y = a[k + shift : k + shift + width] if k + shift >= 0 else [], b[k : k + width]
            codes = [c for _, c in y]
            exact = [w.lower() for w, _ in x] == [w.lower() for w, _ in y]
            loose = len(b) >= d.WINDOW and [c for _, c in x] == codes
            literals = sum(c not in ("#", "@", "%") for c in codes)
            other = sum(c not in ("#", "@", "%") for _, c in x)
            hit = loose if min(literals, other) >= d.LITERALS and len(b) >= d.WINDOW else exact and (len(b) < d.WINDOW or max(literals, other) < d.LITERALS)
            if len(x) < width or not hit:
                continue
            if at is None or k - last > d.WINDOW:
                at, slots = k, {}
            last = k
            for (w, _), (v, c) in zip(x, y):
                if c in ("#", "@", "%"):
                    slots.setdefault(v, set()).add(w)
            if k + width - at >= min(d.RUN, len(b) - 1) and _run_is_good(a, b, at, shift, width):
                return True
    return False


def _run_is_good(a, b, at, shift, width):
    """The whole run from `at` on: long enough, and one value for each of the item's."""
    slots, last = {}, at
    for k in range(at, len(b) - width + 1):
        if k - last > d.WINDOW:
            break
        x, y = a[k + shift : k + shift + width], b[k : k + width]
        few = max(sum(c not in ("#", "@", "%") for _, c in z) for z in (x, y)) < d.LITERALS
        same = [w.lower() for w, _ in x] == [w.lower() for w, _ in y]
        if len(x) == width and (same if few or len(b) < d.WINDOW else [c for _, c in x] == [c for _, c in y]):
            last = k
            for (w, _), (v, c) in zip(x, y):
                if c in ("#", "@", "%"):
                    slots.setdefault(v, set()).add(w)
    return last + width - at >= min(d.RUN, len(b) - 1) and all(len(v) == 1 for v in slots.values())


SHORT_ITEMS = ["What is 3 plus 4 in total?", "so few words", "Anna Boris 3 4 Carl 7 km Dora 9 Emil 12 Fred 8", ITEM]


def altered(rnd):
    """The item with other values, some of them twisted, within other words."""
    words, out = ITEM.split(), []
    values = {w: rnd.choice(["7", "12", "31", "Boris", "Clara", w, w]) for w in ("120", "3", "2", "Anna")}
    for w in words:
        w = values.get(w, w)
        out.append(rnd.choice(["5", "Dave"]) if rnd.random() < 0.03 else "oddly" if rnd.random() < 0.03 else w)
    fill = lambda: " ".join(rnd.choices("some plain words stand about here 4 Max km".split(), k=rnd.randrange(12)))
    return f"{fill()} {' '.join(out)} {fill()}"


def test_against_plain_rule(spark, monkeypatch):
    """The rule, written plainly, on re-parameterised texts; joined by broadcast and by shuffle, and with ids that repeat."""
    rnd = random.Random(11)
    texts = [altered(rnd) for _ in range(120)] + SHORT_ITEMS + [f"first words, {t} and more" for t in SHORT_ITEMS] + ["what is 3 plus 5 in total", "WHAT IS 3 PLUS 4 IN TOTAL", "Anna Boris 3 4 Carl 7 km Dora 9 Emil 12 Fred 9"]
    ids = [None if k % 50 == 7 else k // 2 for k in range(len(texts))]
    want = {(i, k) for i, t in zip(ids, texts) for k, item in enumerate(SHORT_ITEMS) if plain_hits(t, item)}
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, h string").repartition(3)
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(SHORT_ITEMS)], "item_id int, text string, width int")
    for rows in (d.BROADCAST_ROWS, 0):
        monkeypatch.setattr(d, "BROADCAST_ROWS", rows)
        got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
        assert got == want and 40 < len(want) < 120


def test_long_texts_in_pieces(spark, monkeypatch):
    """No row holds more tokens than a piece, however long its text; windows across the cuts are found all the same, once."""
    monkeypatch.setattr(d, "PIECE", 11)
    rnd = random.Random(5)
    texts = [" ".join(altered(rnd) for _ in range(k % 7)) for k in range(40)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = [(r.doc_id, r.first, len(r.tokens)) for r in d.pieces(d.tokenized(docs)).collect()]
    assert max(n for _, _, n in sizes) == 11 + d.WINDOW and len(sizes) > 400 and {i for i, _, _ in sizes} == set(range(43))
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(SHORT_ITEMS) if plain_hits(t, item)}
    bench = spark.createDataFrame(list(enumerate(SHORT_ITEMS)), "item_id long, text string")
    for rows in (d.BROADCAST_ROWS, 0):
        monkeypatch.setattr(d, "BROADCAST_ROWS", rows)
        assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()} == want and want
        per = d.matches(docs, bench).groupBy("doc_id", "row", "at", "item_id", "item_at").count()
        assert per.where("count > 1").isEmpty()


def test_repeated_ids(spark):
    """Two variants under one id don't make each other's slots inconsistent."""
    rows = [(1, ITEM.replace("3 bags", "7 bags")), (1, ITEM.replace("3 bags", "9 bags")), (2, ITEM.replace("3 bags", "7 bags")), (None, ITEM), (None, "other words")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id for r in d.contaminated(docs, bench).collect()), key=str) == [1, 2, None]
    assert [tuple(r) for r in d.clean(docs, bench).collect()] == rows[3:]


def test_against_plain_search(spark, sf):
    """Every document that holds an item's words, in any case and with any signs between, and no other."""
    base = sf.rsplit("/", 1)[0] + "/sf0.01"
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items if t in plain(r.text or "")}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    assert want and got >= want
    # what is found besides holds most of the item
    assert len(got - want) <= 0.05 * len(want)


def test_native(spark, sf):
    plan = d.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
