"""Operators on small literal tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folium.functions import html
from folium.functions import text as T
from folium.operators import grids, relations, sequence


def test_packing_closes_before_the_row_that_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 20, 1, 1, 1, 1])], "k int, o bigint, s int")
    got = sequence.pack(rows, "k", "o", F.col("s"), 10, 3).orderBy("batch").collect()
    assert [(r["first"], r["last"], r["n"], r["size"]) for r in got] == [(0, 1, 2, 10), (2, 2, 1, 20), (3, 5, 3, 3), (6, 6, 1, 1)]


def test_packing_breaks_on_group(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, None)], "k int, o bigint, g string")
    got = sequence.pack(rows, "k", "o", F.lit(1), 100, 100, F.col("g")).orderBy("batch").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 1), (2, 2), (3, 3)]


def test_anchored_clusters_compare_with_the_first(spark):
    rows = spark.createDataFrame([(1, x) for x in (0.0, 3.0, 4.0, 7.0, 8.5)], "k int, x double")
    got = sorted((r["anchor"], r["n"]) for r in sequence.anchored_clusters(rows, "k", "x", 4.0).collect())
    assert got == [(0.0, 3), (7.0, 2)]


def test_reordered_marks_both_of_a_crossing_pair(spark):
    rows = spark.createDataFrame([(1, o, n) for n, o in enumerate([0, 2, 1, 3])], "k int, old int, new int")
    got = {r["new"]: r["moved"] for r in sequence.reordered(rows, "k", "old", "new").collect()}
    assert got == {0: False, 1: True, 2: True, 3: False}


def test_section_path_keeps_the_first_entries(spark):
    rows = spark.createDataFrame([(1, 0, 0, "1"), (1, 1, 1, "1.1"), (1, 2, None, None), (1, 3, 0, "2"), (1, 4, 2, "2.x")], "k int, o int, d int, n string")
    got = [r["path"] for r in sequence.section_paths(rows, "k", "o", F.col("d"), F.col("n")).orderBy("o").collect()]
    assert got == [["1"], ["1", "1.1"], ["1", "1.1"], ["2"], ["2", "2.x"]]


def test_html_reader_treats_scripts_as_opaque():
    got = html.read('<nav><p>no</p></nav><h1>A &amp; B</h1><script>var t="<p>x</p>";</script><p><b>one<br><p>two<!-- <p>c</p> --><ul><li>three</ul>')
    assert got == [("sec", "A & B"), ("p", "one"), ("p", "two"), ("li", "three")]
    assert html.read(None) == []


def test_grid_places_spans_and_finds_faults(spark):
    cells = [("ok", 0, 0, "h", 2, 1), ("ok", 1, 0, "a", 1, 2), ("ok", 1, 1, "b", 1, 1), ("ok", 2, 0, "c", 1, 1), ("bad", 0, 0, "x", 1, 1), ("bad", 1, 0, "y", 2, 1)]
    squares = grids.place_cells(spark.createDataFrame(cells, "t string, r int, k int, text string, colspan int, rowspan int"), "t")
    at = {(r["r"], r["c"]): r["text"] for r in squares.filter("t = 'ok'").collect()}
    assert at == {(0, 0): "h", (0, 1): "h", (1, 0): "a", (1, 1): "b", (2, 0): "a", (2, 1): "c"}
    assert {r["t"]: r["fault"] for r in grids.grid_faults(squares, "t").collect()} == {"ok": None, "bad": "ragged"}


def test_grids_equal_placing_cell_by_cell(spark):
    draw = random.Random(3)
    cells = [(t, r, k, f"{r}.{k}", draw.choice([1, 1, 1, 2, 3]), draw.choice([1, 1, 1, 2, 4])) for t in range(40) for r in range(5) for k in range(draw.randrange(1, 5))]
    want = []
    for t in range(40):
        taken = []
        for _, r, _, text, wide, high in sorted(c for c in cells if c[0] == t):
            free = next(c for c in range(99) if (r, c) not in taken)
            covered = [(r + i, free + j) for i in range(high) for j in range(wide)]
            taken += covered
            want += [(t, *square, text) for square in covered]
    draw.shuffle(cells)
    got = grids.place_cells(spark.createDataFrame(cells, "t long, r int, k int, text string, colspan int, rowspan int"), "t").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_folds_are_linear_in_a_long_document(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc"), F.col("id").alias("ord"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, F.col("id") / 10 % 3).cast("int").alias("depth"))
    packed = sequence.pack(rows, "doc", "ord", F.lit(7), 700, 60).collect()
    assert [(r["batch"], r["first"], r["last"], r["n"], r["size"]) for r in sorted(packed)][-1] == (1666, 99960, 99999, 40, 280) and len(packed) == 1667
    paths = sequence.section_paths(rows, "doc", "ord", F.col("depth"), F.col("ord").cast("string"))
    assert paths.columns == [*rows.columns, "path"] and paths.filter("ord = 99999").first()["path"] == ["99990"]
    assert paths.filter("ord = 99989").first()["path"] == ["99960", "99970", "99980"]
    assert sequence.anchored_clusters(rows, "doc", "ord", 9.0).agg(F.count("*"), F.max("n")).first()[:] == (10_000, 10)
    assert sequence.pack(rows.filter("false"), "doc", "ord", F.lit(7), 700, 60).count() == 0


def test_best_cells_keep_ties(spark):
    rows = spark.createDataFrame([(1, 0, 0.3), (1, 0, 0.5), (1, 0, 0.5), (1, 1, 9.0)], "t int, c int, v double")
    assert grids.best_cells(rows, "t", "c", F.col("v")).count() == 2


def test_unique_links_leave_duplicates_unmatched(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b")], "d int, id bigint, s string")
    new = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 7, "c")], "d int, id bigint, s string")
    got = sorted((r["kind"], r["old_id"], r["new_id"]) for r in relations.link_unique(old, new, ["d"], "s").collect() if True)
    assert got[0][0] == "added" and len([g for g in got if g[0] == "same"]) == 1 and len([g for g in got if g[0] == "missing"]) == 2


def test_missing_tokens_count_repeats(spark):
    a = spark.createDataFrame([(1, "5"), (1, "5"), (1, "7%")], "k int, token string")
    b = spark.createDataFrame([(1, "5"), (1, "7%"), (1, "9")], "k int, token string")
    assert relations.missing_tokens(a, b, ["k"]).first()["n"] == 1


def test_status_and_numbers(spark):
    rows = spark.createDataFrame([("paused", "running", "paused"), ("paused", "queued", "queued"), ("running", "done", "done")], "o string, n string, e string")
    assert rows.filter(relations.merged_status(F.col("o"), F.col("n")) != F.col("e")).count() == 0
    got = spark.createDataFrame([("−3.5% and x2, 1,000 or 5e-3",)], "t string").select(T.numbers(F.col("t")).alias("n")).first()["n"]
    assert got == ["-3.5%", "1,000", "5e-3"]


def test_references_that_all_rows_share(spark):
    """Known or not, told twice or null; the rows that share one stay where they are."""
    refs = spark.range(3000).selectExpr("id % 7 AS own", "explode(array(id, id + 1, -1L, 5L, NULL)) AS ref")
    keys = spark.createDataFrame([(5,), (5,), (9,), (-2,), (None,)], "ref long")
    got = relations.known_references(refs, keys, "own")
    want = {k: 2 * sum(1 for i in range(3000) if i % 7 == k) for k in range(7)}
    for i in range(3000):
        want[i % 7] += 2 * ((i == 5) + (i == 4)) + (i == 9) + (i == 8)
    assert {r["own"]: r["n"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (-1,5)" in plan or "IN (5,-1)" in plan or "INSET" in plan
    assert relations.known_references(refs.filter("false"), keys, "own").count() == 0
