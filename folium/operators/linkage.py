"""Linking two extractions of one document, in passes; each takes only what the ones before have left.

old, new: doc_id, id (bigint), ord, type, section, page, n, anchor, text, sig, x0, y0, x1, y1, and perhaps fingerprint (of a picture).
Rows without a page or rectangle have no place, so they link by anchor, signature, turn or label only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from folium.sources.tables import settled

#: Texts count as one with an edit from this similarity on, if no longer than a tenth more and at least this long.
ALIKE, LENGTHS, LEAST = 0.94, 0.9, 40
MARGIN, STEP = 0.025, 0.01
#: Characters outside of the longest block, up to which that is looked for at the ends of both texts.
EDITED = 32
PROSE = ("p", "li", "sec", "sub", "ssub")
LABELLED = ("fig", "tab", "eq", "sec", "sub", "ssub")


def _pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are unique on both sides."""

    def once(df: DataFrame, name: str) -> DataFrame:
        known = df.filter(" and ".join(f"{k} is not null" for k in keys))
        return known.withColumn("_k", F.count("*").over(Window.partitionBy("doc_id", *keys))).filter("_k = 1").select("doc_id", *keys, F.col("id").alias(name))

    return once(old, "old_id").join(once(new, "new_id"), ["doc_id", *keys]).select("doc_id", "old_id", "new_id")


def _without(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return rows.join(found.select("doc_id", F.col(name).alias("id")), ["doc_id", "id"], "left_anti")


def geometry(a: str, b: str) -> Column:
    """1 - IoU + distance of centres / 1000, or null if the rectangles are too far apart."""
    c = F.col
    w = F.greatest(F.least(c(f"{a}.x1"), c(f"{b}.x1")) - F.greatest(c(f"{a}.x0"), c(f"{b}.x0")), F.lit(0.0))
    h = F.greatest(F.least(c(f"{a}.y1"), c(f"{b}.y1")) - F.greatest(c(f"{a}.y0"), c(f"{b}.y0")), F.lit(0.0))
    area = lambda x: (c(f"{x}.x1") - c(f"{x}.x0")) * (c(f"{x}.y1") - c(f"{x}.y0"))
    iou = w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))
    middle = lambda x, p: (c(f"{x}.{p}0") + c(f"{x}.{p}1")) / 2
    far = F.sqrt(F.pow(middle(a, "x") - middle(b, "x"), 2) + F.pow(middle(a, "y") - middle(b, "y"), 2))
    tall = F.greatest(c(f"{a}.y1") - c(f"{a}.y0"), c(f"{b}.y1") - c(f"{b}.y0"))
    wide = F.least(c(f"{a}.x1") - c(f"{a}.x0"), c(f"{b}.x1") - c(f"{b}.x0"))
    near = (iou >= 0.15) | ((far <= F.greatest(F.lit(24.0), F.least(F.lit(60.0), 0.5 * tall))) & (w >= 0.5 * wide))
    return F.when(near, 1 - iou + far / 1000)


def mutual_best(scored: DataFrame, margin: float) -> DataFrame:
    """doc_id, old_id, new_id: pairs (with score, low is good) that are the best of both rows, by over the margin to the second best.

    What is linked leaves the others, among which the same is looked for, until nothing is found.
    """

    def lead(rows: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy("doc_id", side).orderBy("score", "old_id", "new_id")
        first = rows.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).filter("_r = 1")
        return first.filter(F.col("_next").isNull() | (F.col("_next") - F.col("score") > margin)).select("doc_id", "old_id", "new_id")

    rows, found = settled(scored), None
    while True:
        some = settled(lead(rows, "old_id").join(lead(rows, "new_id"), ["doc_id", "old_id", "new_id"]))
        found = some if found is None else found.unionByName(some)
        if some.isEmpty():
            return found
        rows = settled(rows.join(some.select("doc_id", "old_id"), ["doc_id", "old_id"], "left_anti").join(some.select("doc_id", "new_id"), ["doc_id", "new_id"], "left_anti"))


def _placed(old: DataFrame, new: DataFrame, on: Column) -> DataFrame:
    """Pairs of rows of one page whose rectangles are near each other, with `score`."""
    j = old.alias("a").join(new.alias("b"), on & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")))
    return j.withColumn("score", geometry("a", "b")).filter("score is not null")


def _by_place(old: DataFrame, new: DataFrame) -> DataFrame:
    scored = _placed(old, new, F.col("a.sig") == F.col("b.sig"))
    return mutual_best(scored.select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"), "score"), 1e-6)


def _by_turn(old: DataFrame, new: DataFrame) -> DataFrame:
    """The i-th with the i-th of one signature, page and section, where both sides have as many; not if their rectangles speak against it."""
    keys = ["doc_id", "sig", F.coalesce("page", F.lit(-1)).alias("_page"), F.coalesce("section", F.lit("")).alias("_section")]

    def numbered(df: DataFrame) -> DataFrame:
        rows = df.filter("sig is not null").select(*keys, "id", "ord", "x0", "y0", "x1", "y1")
        w = Window.partitionBy("doc_id", "sig", "_page", "_section")
        return rows.withColumn("_i", F.row_number().over(w.orderBy("ord", "id"))).withColumn("_n", F.count("*").over(w))

    same = ["doc_id", "sig", "_page", "_section", "_i", "_n"]
    a, b = numbered(old).alias("a"), numbered(new).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same]
    apart = F.col("a.x0").isNotNull() & F.col("b.x0").isNotNull() & geometry("a", "b").isNull()
    return a.join(b, on).filter(~apart).select("a.doc_id", F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"))


def _by_label(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unique labels of a section, at most a page apart."""
    pairs = _pairs(old.filter(F.col("type").isin(*LABELLED)), new.filter(F.col("type").isin(*LABELLED)), ["type", "n", "section"])
    page = lambda df, x: df.select("doc_id", F.col("id").alias(f"{x}_id"), F.col("page").alias(x))
    both = pairs.join(page(old, "old"), ["doc_id", "old_id"]).join(page(new, "new"), ["doc_id", "new_id"])
    return both.filter("old is null or new is null or abs(old - new) <= 1").select("doc_id", "old_id", "new_id")


def _shared(a: str, b: str) -> int:
    """Characters at the start of both."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _matching(a: str, b: str) -> int:
    """Characters in the blocks that SequenceMatcher finds.

    It takes the longest block first, then goes on at its left and right. A block at an end of both that is all but EDITED characters
    is found at once; it is the longest if no other place of both holds as many equal characters.
    """
    front, back = _shared(a, b), _shared(a[::-1], b[::-1])
    size = max(front, back)
    if size and max(len(a), len(b)) - size <= EDITED:
        i, j = (0, 0) if front >= back else (len(a) - size, len(b) - size)
        places = ((x, a[x : x + size]) for x in range(len(a) - size + 1))
        if not any(b.startswith(block, y) for x, block in places for y in range(len(b) - size + 1) if (x, y) != (i, j)):
            return size + _matching(a[:i], b[:j]) + _matching(a[i + size :], b[j + size :])
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """SequenceMatcher's ratio without junk; what is certain to be below `least` is 0."""
    n = len(a) + len(b)
    if not n:
        return 1.0
    if least and (2.0 * min(len(a), len(b)) / n < least or 2.0 * (Counter(a) & Counter(b)).total() / n < least):
        return 0.0
    return 2.0 * _matching(a, b) / n


def similarity(least: float) -> Callable[[Column, Column], Column]:
    """Share of matching characters in order; 0 if it is certain to be below `least`. Not deterministic for Spark, which would work it out again for each filter on it."""

    @F.pandas_udf(DoubleType())
    def shares(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y, least) for x, y in zip(a, b, strict=True)], dtype=float)

    return shares.asNondeterministic()


@F.pandas_udf(BooleanType())
def explained(target: pd.Series, own: pd.Series, runs: pd.Series, score: pd.Series) -> pd.Series:
    """Whether one of the runs is nearer to the target than the row's own text is: in length, and in characters by over STEP."""

    def nearer(t: str, o: str, run: str, r: float) -> bool:
        return abs(len(t) - len(run)) < abs(len(t) - len(o)) and ratio(t, run) > r + STEP

    return pd.Series([any(nearer(t, o, run, r) for run in rs) for t, o, rs, r in zip(target, own, runs, score, strict=True)], dtype=bool)


def _with_runs(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The rows that are not linked yet, with the texts of the two or three neighbouring ones, itself among them at an end, that they could be parts of."""
    linked = found.select("doc_id", F.col(name).alias("id"), F.lit(True).alias("_linked"))
    told = rows.join(linked, ["doc_id", "id"], "left").withColumn("_free", F.col("_linked").isNull())
    w = Window.partitionBy("doc_id").orderBy("ord", "id")
    me = F.struct("text", "type", "section", "page", "_free")
    near = {f"_{k}": F.lag(me, -k).over(w) for k in (-2, -1, 1, 2)}

    def run(*members: str) -> Column:
        others = [F.col(m) for m in members if m != "me"]
        whole = reduce(lambda x, y: x & y, [m.isNotNull() & m["_free"] & (m["type"] == F.col("type")) & m["section"].eqNullSafe(F.col("section")) for m in others])
        pages = F.array(F.col("page"), *(m["page"] for m in others))
        close = F.coalesce(F.array_max(pages) - F.array_min(pages) <= 1, F.lit(True))
        return F.when(whole & close, F.concat_ws(" ", *(F.col("text") if m == "me" else F.col(m)["text"] for m in members)))

    runs = F.array_compact(F.array(run("_-1", "me"), run("me", "_1"), run("_-2", "_-1", "me"), run("me", "_1", "_2")))
    return told.withColumns(near).withColumn("runs", runs).filter("_free").drop("_linked", "_free", *near)


def _by_text(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edited texts of one type and section in nearby places; not if a split or merged neighbour explains the text better."""
    n, m = F.length("a.text"), F.length("b.text")
    part = F.col("a.text").contains(F.col("b.text")) | F.col("b.text").contains(F.col("a.text"))
    prose = old.filter(F.col("type").isin(*PROSE) & (F.length("text") >= LEAST))
    j = _placed(prose, new, (F.col("a.type") == F.col("b.type")) & F.col("a.section").eqNullSafe(F.col("b.section")))
    alike = j.filter((F.least(n, m) >= LENGTHS * F.greatest(n, m)) & ~part).withColumn("r", similarity(ALIKE)(F.col("a.text"), F.col("b.text"))).filter(F.col("r") >= ALIKE)
    better = explained(F.col("a.text"), F.col("b.text"), F.col("b.runs"), F.col("r")) | explained(F.col("b.text"), F.col("a.text"), F.col("a.runs"), F.col("r"))
    kept = alike.withColumn("better", better).filter("not better")
    return mutual_best(kept.select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"), (1 - F.col("r")).alias("score")), MARGIN)


def link(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, old_id, new_id, step: anchors, pictures, unique signatures, places of equal ones, their turn, labels, then similar texts. Ambiguous rows and notes stay unlinked."""
    old, new = (settled(df.filter(~F.col("type").isin("note", "card"))) for df in (old, new))
    visual = lambda df: df.filter("type in ('fig', 'tab', 'eq')")
    steps = {
        "anchor": lambda a, b: _pairs(a, b, ["type", "anchor"]),
        "picture": lambda a, b: _pairs(visual(a), visual(b), ["type", "fingerprint"]),
        "signature": lambda a, b: _pairs(a, b, ["sig"]),
        "place": _by_place,
        "turn": _by_turn,
        "label": _by_label,
    }
    if "fingerprint" not in old.columns or "fingerprint" not in new.columns:
        del steps["picture"]
    found = None
    for name, step in steps.items():
        a = old if found is None else _without(old, found, "old_id")
        b = new if found is None else _without(new, found, "new_id")
        some = settled(step(a, b).withColumn("step", F.lit(name)))
        found = some if found is None else found.unionByName(some)
    text = _by_text(_with_runs(old, found, "old_id"), _with_runs(new, found, "new_id")).withColumn("step", F.lit("text"))
    return found.unionByName(settled(text))


def with_changes(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, old_id, new_id, kind: same, changed, added or missing."""
    s = links.join(old.select("doc_id", F.col("id").alias("old_id"), F.col("sig").alias("a")), ["doc_id", "old_id"]).join(new.select("doc_id", F.col("id").alias("new_id"), F.col("sig").alias("b")), ["doc_id", "new_id"])
    both = s.select("doc_id", "old_id", "new_id", F.when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("kind"))
    gone = _without(old, links, "old_id").select("doc_id", F.col("id").alias("old_id"), F.lit(None).cast("bigint").alias("new_id"), F.lit("missing").alias("kind"))
    more = _without(new, links, "new_id").select("doc_id", F.lit(None).cast("bigint").alias("old_id"), F.col("id").alias("new_id"), F.lit("added").alias("kind"))
    return both.unionByName(gone).unionByName(more)
