"""Linkage, layout and staged enrichment on literal tables."""

from __future__ import annotations

import math
import random
import tempfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from folium.operators import enrich, layout, linkage, relations

LINK = "doc_id bigint, id bigint, ord bigint, type string, section string, page int, n string, anchor string, text string, sig string, x0 double, y0 double, x1 double, y1 double"
PROSE = "A paragraph about measuring the growth of small plants in wet soil, with 3 repeats."


def block(i, text, page=1, y=None, anchor=None, kind="p", n=None, section="1"):
    box = (None,) * 4 if y is None else (0.0, float(y), 200.0, y + 30.0)
    return (1, i, i, kind, section, page, n, anchor, text, f"{kind}|{text}", *box)


def linked(spark, old, new):
    a, b = spark.createDataFrame(old, LINK), spark.createDataFrame(new, LINK)
    return {(r["old_id"], r["new_id"]): r["step"] for r in linkage.link(a, b).collect()}


def test_links_by_anchor_signature_and_label(spark):
    old = [block(1, "same text", anchor="a"), block(2, "unique"), block(3, "Table of x", kind="tab", n="Table 2"), block(4, "gone")]
    new = [block(11, "other text", anchor="a"), block(12, "unique"), block(13, "Table of y", kind="tab", n="Table 2"), block(14, "added")]
    assert linked(spark, old, new) == {(1, 11): "anchor", (2, 12): "signature", (3, 13): "label"}
    a, b = spark.createDataFrame(old, LINK), spark.createDataFrame(new, LINK)
    kinds = sorted(r["kind"] for r in linkage.with_changes(a, b, linkage.link(a, b)).collect())
    assert kinds == ["added", "changed", "changed", "missing", "same"]


def test_geometry_decides_between_duplicates(spark):
    got = linked(spark, [block(1, "twice", y=100), block(2, "twice", y=400)], [block(11, "twice", y=402), block(12, "twice", y=101)])
    assert got == {(1, 12): "place", (2, 11): "place"}


def test_duplicates_without_places_need_equal_counts(spark):
    old = [block(1, "twice"), block(2, "twice")]
    assert linked(spark, old, [block(11, "twice"), block(12, "twice")]) == {(1, 11): "turn", (2, 12): "turn"}
    assert linked(spark, old, [block(11, "twice"), block(12, "twice"), block(13, "twice")]) == {}
    assert linked(spark, [block(1, "t")], [block(11, "t", page=2), block(12, "t", page=3)]) == {}


def test_edited_prose_links_unless_ambiguous(spark):
    old = [block(1, PROSE, y=100)]
    edit = PROSE.replace("3", "4")
    assert linked(spark, old, [block(11, edit, y=104)]) == {(1, 11): "text"}
    assert linked(spark, old, [block(11, edit, y=400)]) == {} == linked(spark, old, [block(11, edit)]) == linked(spark, old, [block(11, edit, page=2, y=104)])
    assert linked(spark, old, [block(11, edit, y=100), block(12, PROSE.replace("3", "5"), y=104)]) == {}
    assert linked(spark, old, [block(11, PROSE[:60], y=100)]) == {}


def test_split_and_merged_paragraphs_stay_unlinked(spark):
    whole = f"{PROSE} It was hot. {PROSE} The end was near."
    parts = [block(11, whole[:-6].replace("3", "4"), y=100), block(12, whole[-5:], y=132)]
    assert linked(spark, [block(1, whole, y=100)], parts) == {} == linked(spark, parts, [block(1, whole, y=100)])
    assert linked(spark, [block(1, whole, y=100)], [parts[0], block(12, whole[-5:], y=132, section="2")]) == {(1, 11): "text"}


def test_labels_pictures_and_notes(spark):
    old = [block(1, "x", kind="tab", n="Table 2", page=3), block(2, "y", kind="fig", n="Figure 1"), block(3, "a note", kind="note")]
    assert linked(spark, old, [block(11, "z", kind="tab", n="Table 2", page=4), block(12, "w", kind="fig", n="Figure 1", page=3), block(13, "a note", kind="note")]) == {(1, 11): "label"}
    with_print = lambda rows, prints: spark.createDataFrame([(*r, p) for r, p in zip(rows, prints, strict=True)], LINK + ", fingerprint string")
    got = linkage.link(with_print(old[1:], ["f", "f"]), with_print([block(21, "q", kind="fig"), block(22, "r", kind="fig")], ["f", None])).collect()
    assert [(r["old_id"], r["new_id"], r["step"]) for r in got] == [(2, 21, "picture")]


def near(a, b):
    """The score of two rectangles of a page, or None."""
    if a["page"] is None or a["page"] != b["page"] or a["x0"] is None or b["x0"] is None:
        return None
    w = max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    both = w * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    iou = both / (size(a) + size(b) - both)
    far = math.dist(((a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2), ((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2))
    reach = max(24, min(60, max(a["y1"] - a["y0"], b["y1"] - b["y0"]) / 2))
    return 1 - iou + far / 1000 if iou >= 0.15 or far <= reach and w >= 0.5 * min(a["x1"] - a["x0"], b["x1"] - b["x0"]) else None


def one_by_one(old, new):
    """The links of one document by comparing all pairs, in plain loops."""
    found, ratio = {}, lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio()
    free = lambda rows, side: [r for r in rows if r["type"] != "note" and all(p[side] != r["id"] for p in found)]

    def by_key(step, key, fits=lambda a, b: True):
        a, b = ({k: [r for r in rows if key(r) == k] for k in {key(r) for r in rows} - {None}} for rows in (free(old, 0), free(new, 1)))
        found.update({(a[k][0]["id"], b[k][0]["id"]): step for k in a.keys() & b.keys() if len(a[k]) == len(b[k]) == 1 and fits(a[k][0], b[k][0])})

    def by_score(step, scores, margin):
        while True:
            picks = []
            for (o, n), s in scores.items():
                rest = [t for (p, q), t in scores.items() if (p == o) != (q == n)]
                if all(t - s > margin for t in rest):
                    picks.append((o, n))
            if not picks:
                return
            found.update(dict.fromkeys(picks, step))
            scores = {k: s for k, s in scores.items() if not any(k[0] == o or k[1] == n for o, n in picks)}

    def explained(rows, side, r, target, score):
        mine = sorted((x for x in rows if x["type"] != "note"), key=lambda x: x["ord"])
        left, i = {x["id"] for x in free(rows, side)}, next(k for k, x in enumerate(mine) if x["id"] == r["id"])
        for lo, hi in ((i - 1, i), (i, i + 1), (i - 2, i), (i, i + 2)):
            run = mine[max(lo, 0) : hi + 1]
            if lo < 0 or len(run) < hi - lo + 1 or any(x["id"] not in left or (x["type"], x["section"]) != (r["type"], r["section"]) for x in run):
                continue
            text = " ".join(x["text"] for x in run)
            if max(x["page"] for x in run) - min(x["page"] for x in run) <= 1 and abs(len(target) - len(text)) < abs(len(target) - len(r["text"])) and ratio(target, text) > score + 0.01:
                return True
        return False

    by_key("anchor", lambda r: r["anchor"] and (r["type"], r["anchor"]))
    by_key("signature", lambda r: r["sig"])
    pairs = lambda: [(a, b) for a in free(old, 0) for b in free(new, 1)]
    by_score("place", {(a["id"], b["id"]): near(a, b) for a, b in pairs() if a["sig"] == b["sig"] and near(a, b) is not None}, 1e-6)
    at = lambda r: (r["sig"], r["page"], r["section"])
    for k in {at(r) for r in free(old, 0)}:
        a, b = (sorted((r for r in free(rows, side) if at(r) == k), key=lambda r: r["ord"]) for side, rows in ((0, old), (1, new)))
        if len(a) == len(b):
            found.update({(x["id"], y["id"]): "turn" for x, y in zip(a, b, strict=True) if x["x0"] is None or y["x0"] is None or near(x, y) is not None})
    by_key("label", lambda r: r["n"] and r["type"] in linkage.LABELLED and (r["type"], r["n"], r["section"]) or None, lambda a, b: abs(a["page"] - b["page"]) <= 1)
    scores = {}
    for a, b in pairs():
        x, y = a["text"], b["text"]
        if a["type"] != b["type"] or a["type"] not in linkage.PROSE or a["section"] != b["section"] or near(a, b) is None or len(x) < 40 or min(len(x), len(y)) < 0.9 * max(len(x), len(y)) or x in y or y in x:
            continue
        s = ratio(x, y)
        if s >= 0.94 and not explained(new, 1, b, x, s) and not explained(old, 0, a, y, s):
            scores[a["id"], b["id"]] = 1 - s
    by_score("text", scores, 0.025)
    return found


def test_links_equal_a_comparison_of_all_pairs(spark):
    draw, names = random.Random(5), [c.split()[0] for c in LINK.split(", ")]
    made = {0: [], 1: []}
    for doc in range(20):
        for side in made:
            for i in range(18):
                text = draw.choice([PROSE, PROSE.replace("3", str(draw.randrange(10))), PROSE[:-6], PROSE[-5:], "twice", f"unique {i}", f"other {draw.random()}"])
                kind = draw.choice(["p", "p", "p", "p", "li", "sec", "tab", "note"])
                r = block(100 * side + i, text, draw.choice([1, 1, 2, 3]), draw.choice([None] * 5 + list(range(0, 200, 20))), draw.choice([None] * 9 + list("abcd")), kind, draw.choice([None, None, "1", "2"]), draw.choice(["1", "1", "1", "2"]))
                made[side].append((doc, *r[1:]))
    got = {(r["doc_id"], r["old_id"], r["new_id"]): r["step"] for r in linkage.link(*(spark.createDataFrame(made[side], LINK) for side in made)).collect()}
    want = {}
    for doc in range(20):
        old, new = ([dict(zip(names, r, strict=True)) for r in made[side] if r[0] == doc] for side in made)
        want |= {(doc, *k): step for k, step in one_by_one(old, new).items()}
    assert got == want and {"anchor", "signature", "place", "turn", "label", "text"} <= set(want.values())


def span(page, block_no, line, x, y, text, size=10.0, bold=False, wide=100.0):
    return (1, page, block_no, line, float(x), float(y), x + wide, y + size, size, bold, text)


SPANS = "doc_id bigint, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string"


def test_lines_furniture_and_body(spark):
    long = "a line of body text that has more than forty-five characters"
    rows = [span(p, 0, 0, 50, 10, "Running title", 8.0) for p in (1, 2, 3)] + [span(1, 1, 0, 150, 300, "world", bold=True), span(1, 1, 0, 50, 300, "hello ", bold=True), span(2, 1, 0, 50, 300, long), span(3, 1, 0, 50, 300, long, 12.0), span(3, 2, 0, 50, 400, long)]
    got = layout.lines(spark.createDataFrame(rows, SPANS))
    assert ("hello world", True) in {(r["text"], r["bold"]) for r in got.collect()}
    assert [r["text"] for r in layout.furniture(got, F.lit(800.0)).collect()] == ["Running title"]
    assert layout.body_size(got).first()["body"] == 10.0


def test_two_columns_are_read_one_after_the_other(spark):
    items = [("L1", 0, 100, 280), ("R1", 310, 100, 590), ("L2", 0, 200, 280), ("R2", 310, 200, 590), ("title", 0, 50, 590), ("wide", 0, 300, 590), ("L3", 0, 350, 280), ("R3", 310, 350, 590)]
    rows = spark.createDataFrame([(1, 1, n, float(x), float(y), float(z), y + 20.0) for n, x, y, z in items], "doc_id bigint, page int, name string, x0 double, y0 double, x1 double, y1 double")
    assert [r["name"] for r in layout.reading_order(rows, 600.0).orderBy("place").collect()] == ["title", "L1", "L2", "R1", "R2", "wide", "L3", "R3"]


def test_paragraphs_rejoin_over_asides(spark):
    rows = [(1, 0, "p", 1, "The method is"), (1, 1, "fig", 1, "Figure 1"), (1, 2, "p", 2, "simple and fast."), (1, 3, "p", 2, "New one"), (1, 4, "sec", 2, "References"), (1, 5, "p", 2, "a cut"), (1, 6, "p", 3, "entry stays")]
    got = layout.rejoined(spark.createDataFrame(rows, "doc_id bigint, ord bigint, type string, page bigint, text string")).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in got] == [(0, "The method is simple and fast."), (1, "Figure 1"), (3, "New one"), (4, "References"), (5, "a cut"), (6, "entry stays")]


def test_paragraphs_rejoin_from_their_first_page(spark):
    rows = [(1, 0, "p", 1, "one,"), (1, 1, "p", 2, "two,"), (1, 2, "p", 3, "three"), (1, 3, "li", 3, "item,"), (1, 4, "p", 3, "goes on"), (1, 5, "sec", 3, "Head,"), (1, 6, "p", 3, "after"), (2, 0, "p", 1, "other doc")]
    got = layout.rejoined(spark.createDataFrame(rows, "doc_id bigint, ord bigint, type string, page bigint, text string")).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"], r["page"], r["text"]) for r in got] == [(1, 0, 1, "one, two,"), (1, 2, 3, "three"), (1, 3, 3, "item, goes on"), (1, 5, 3, "Head,"), (1, 6, 3, "after"), (2, 0, 1, "other doc")]


def test_hyphens_follow_the_vocabulary(spark):
    texts = spark.createDataFrame([(1, "we are ap- plying self- attention to pre- and post-processing"), (2, "plain")], "id int, text string")
    words = spark.createDataFrame([("applying", 3), ("self-attention", 5), ("selfattention", 1)], "word string, n int")
    got = {r["id"]: r["text"] for r in layout.dehyphenated(texts, words).collect()}
    assert got == {1: "we are applying self-attention to pre- and post-processing", 2: "plain"}


def test_headings_and_captions(spark):
    rows = spark.createDataFrame([("1 Introduction", True), ("2.1.3 Deep", True), ("2.1 Not bold", False), ("References", True), ("Table 3: x", False), ("Fig. 2 y", False)], "t string, b boolean")
    got = rows.select(layout.heading_depth(F.col("t"), F.col("b")).alias("d"), layout.label_kind(F.col("t")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(0, None), (2, None), (None, None), (0, None), (None, "tab"), (None, "fig")]


def test_enrichment_halves_asks_again_and_rejects(spark):
    rows = spark.createDataFrame([(f"i{k}", f"t{k}", "b0") for k in range(6)] + [("bad", "boom", "b1"), ("no", "never", "b2")], "id string, text string, batch string")

    def answer(asked):
        if len(asked) > 3:
            raise ValueError("too long")
        return {i: t.upper() if t != "never" else "x" for i, t in asked} | {"unknown": "y"}

    at = tempfile.mkdtemp(prefix="spark-enrich-")
    count = [0]

    def save(df):
        count[0] += 1
        df.write.parquet(f"{at}/{count[0]}")
        return spark.read.parquet(f"{at}/{count[0]}")

    got = {r["id"]: (r["answer"], r["status"]) for r in enrich.enrich(rows, answer, lambda t, a: F.upper(t) == a, save=save).collect()}
    assert got == {f"i{k}": (f"T{k}", "done") for k in range(6)} | {"bad": ("BOOM", "done"), "no": (None, "rejected")}


def test_one_bad_row_of_many_fails_alone(spark):
    rows = spark.createDataFrame([(f"i{k}", f"t{k}", "b") for k in range(40)], "id string, text string, batch string")

    def answer(asked):
        if any(i == "i7" for i, _ in asked):
            raise ValueError("bad row")
        return {i: t.upper() for i, t in asked}

    got = {r["id"]: r["status"] for r in enrich.enrich(rows, answer, lambda t, a: F.upper(t) == a).collect()}
    assert got == {f"i{k}": "failed" if k == 7 else "done" for k in range(40)}


def test_enrichment_writes_once_a_round(spark):
    """Batches are asked in the order of their ids; each round's answers are kept with what became of them, and nothing else is."""
    rows = spark.createDataFrame([(f"i{k:02}", f"t{k}", "b") for k in range(20)] + [("z", None, "c")], "id string, text string, batch string").repartition(7)

    def answer(asked):
        if [i for i, _ in asked] != sorted(i for i, _ in asked):
            raise ValueError("out of order")
        return {i: t.upper() for i, t in asked if t and (len(asked) == 1 or i != "i03")}

    kept = []

    def save(df):
        kept.append(df.columns)
        return df.localCheckpoint()

    got = {r["id"]: (r["answer"], r["status"]) for r in enrich.enrich(rows, answer, lambda t, a: F.upper(t) == a, save=save).collect()}
    assert got == {f"i{k:02}": (f"T{k}", "done") for k in range(20)} | {"z": (None, "rejected")}
    assert len(kept) == 2


def test_trees_have_no_cap_and_cycles_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3)], "parent long, child long")
    got = {r["node"]: r["depth"] for r in relations.descendants(edges, spark.createDataFrame([(0,)], "root long")).collect()}
    assert got == {i: i for i in range(13)}


def test_memo_is_asked_first(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string")
    memo = spark.createDataFrame([("a", "kept"), ("z", "other")], "key string, answer string")
    got = {r["key"]: r["answer"] for r in enrich.with_memo(rows, memo, lambda r: r.withColumn("answer", F.upper("text"))).collect()}
    assert got == {"a": "kept", "b": "Y"}


def test_ratio_equals_sequence_matcher(monkeypatch):
    """On edited, periodic and unlike texts; a long text with an edit at one end is not compared place by place."""
    rng = random.Random(5)
    whole = linkage.SequenceMatcher
    asked = []
    monkeypatch.setattr(linkage, "SequenceMatcher", lambda _, a, b, autojunk: asked.append(max(len(a), len(b))) or whole(None, a, b, autojunk=autojunk))
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefghijklmnop "])
        a = "".join(rng.choices(letters, k=rng.randrange(80)))
        if rng.random() < 0.3:
            a = a[: rng.randrange(1, 6)] * rng.randrange(20)
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices(letters + "#", k=rng.randrange(3))
        b = "".join(b)
        want = whole(None, a, b, autojunk=False).ratio()
        assert linkage.ratio(a, b) == want
        assert linkage.ratio(a, b, 0.94) == want or want < 0.94
    asked.clear()
    text = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    assert linkage.ratio(text, text[:5] + "#" + text[6:], 0.94) == 2 * 2999 / 6000 and max(asked, default=0) <= 32
