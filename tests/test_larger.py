"""Queries on what larger tables hold: ids of more digits, equal lines, references cut off. Against their SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folium.functions.html import read
from folium.operators import grids
from folium.operators.artwork import equations
from folium.operators.layout import recognised_lines, rejoined
from folium.operators.tables import _Cells, _page_cells, decorated, html_cells, restored, score_tables, with_heads
from folium.plans.catalog import QUERIES, SQL

from .conftest import same


@pytest.fixture
def tables(spark, tmp_path):
    """put(name, rows, schema): a table of its own; ask(query): the query against its SQL."""
    con = duckdb.connect()

    def put(name, rows, schema):
        path = f"{tmp_path}/{name}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")

    def ask(query):
        df = QUERIES[query](spark, str(tmp_path))
        same(df, con, SQL[query])
        return df

    return put, ask


def test_references_without_a_semicolon_stay(tables):
    put, ask = tables
    put("pages", [(1, "<article><h1>a&amp;&amp;&amp</h1><p>b &lt;c&gt; &quo</p><p>R&D &#39;d&#39; &ampe;</p></article>")], "page_id bigint, html string")
    assert [r["text"] for r in ask("html_page_blocks").orderBy("ord").collect()] == ["a&&&amp", "b <c> &quo", "R&D 'd' &ampe;"]
    assert read("<p>&copy; &nosuch; &amp;lt;") == [("p", "© &nosuch; &lt;")]


def test_equal_lines_have_one_order(tables):
    put, ask = tables
    rows = [(k, 5 * (k % 2), 1, float(q)) for k in range(40) for q in ((11, 10, 12) if k % 3 else (10, 11, 12))]
    put("lineitem", rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double")
    plan = ask("numeric_conflicts")._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("l_quantity#" in line.split("row_number()")[1] for line in windows)


def test_papers_of_more_than_five_digits(tables):
    put, ask = tables
    text = "\n".join(f"line {i} of a text" for i in range(24))
    put("documents", [(i, text) for i in (7, 99999, *range(123450, 123462), 1234560)], "doc_id bigint, text string")
    assert ask("paper_imports").select("paper").distinct().count() == 15


def test_squares_keep_the_columns_of_their_cells(spark):
    rows = [(k, r, c, f"{k}/{r}/{c}", 1 + (c == 1), 1 + (r + c) % 2, c == 2) for k in range(3000) for r in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "t long, r int, k int, text string, colspan int, rowspan int, flag boolean")
    got = grids.place_cells(cells, "t", ("text", "flag")).collect()
    one = sorted(((r["r"], r["c"], r["text"][2:], r["flag"]) for r in got if r["t"] == 7), key=repr)
    assert len(got) == 3000 * len(one) and one[:4] == [(0, 0, "0/0", False), (0, 1, "0/1", False), (0, 2, "0/1", False), (0, 3, "0/2", True)]
    assert all(r["flag"] == r["text"].endswith("/2") and r["text"].startswith(f"{r['t']}/") for r in got)


def test_names_that_others_contain_are_told_apart(spark):
    cells = spark.createDataFrame([(1, False, i, 0, t, 1, 1, False, False) for i, t in enumerate(["Net-N old", "Net-NO", "xNet-N", "a Net-NOT Net-N", "other"])], "t long, head boolean, r int, k int, text string, colspan int, rowspan int, numeric boolean, th boolean")
    own, _ = decorated(cells, "t", spark.createDataFrame([("net-n",), ("Net-NO",)], "name string"))
    assert sorted(r["r"] for r in own.collect()) == [0, 1, 3]


def _shuffles(df, *without):
    """How many shuffles the plan of df has, which holds none of the steps."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in without), plan
    return plan.count("Exchange hashpartitioning")


def test_tables_of_figures_take_one_shuffle(spark):
    words = [(t, 125.0 + 60 * c, 50.0 + 20 * r, 140.0 + 60 * c, 60.0 + 20 * r, f"{r}.{c}") for t in range(50) for r in range(3) for c in range(2)]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    box = "t int, x0 double, y0 double, x1 double, y1 double"
    cells = one([(t, 60.0 * c, 0.0, 60.0 * c + 60, 120.0) for t in range(50) for c in range(4)], box)
    out = score_tables(cells, one(words, f"{box}, text string"), one([], "t int, x0 double, x1 double, y double"), one([(t, 0.0, 120.0, 240.0) for t in range(50)], "t int, y0 double, y1 double, width double"), one([], f"{box}, text string"), "t")
    assert _shuffles(out, "Join", "Window", "Aggregate") == 1 and out.filter("numeric").count() == 300


def _answer(rows, label="a"):
    return "<table><thead><tr><th>h</th><th>i</th></tr></thead>" + "".join(f"<tr><td>{label}</td><td>{v}</td></tr>" for v in rows) + "</table>"


def test_restored_tables_take_one_shuffle(spark):
    old = [(t, h, r, k, x, 1, 1) for t in range(1, 7) for h, r, k, x in ((True, 0, 0, "h"), (True, 0, 1, "i"), (False, 0, 0, "a"), (False, 0, 1, "<b>1</b>"), (False, 1, 0, "a"), (False, 1, 1, "2"))]
    # moved, then right; another label; no table at all; a row too many; unsound; an answer to a table that is not there
    told = [(1, 0, _answer([2, 1])), (1, 1, _answer([1, 2])), (2, 0, _answer([2, 1], "b")), (3, 0, "<p>none"), (3, 1, None), (4, 0, _answer([1, 2, 3])), (5, 0, _answer([1, "2<td>3"])), (5, 1, _answer([3, 4])), (9, 3, _answer([1]))]
    out = restored(spark.createDataFrame(old, "t int, head boolean, r int, k int, text string, colspan int, rowspan int"), spark.createDataFrame(told, "t int, attempt int, html string"), "t")
    assert _shuffles(out, "Join", "Window", "Aggregate") == 1
    assert {r["t"]: (r["attempt"], r["error"]) for r in out.collect()} == {1: (1, None), 2: (0, None), 3: (None, "invalid"), 4: (0, None), 5: (None, "numeric_mismatch"), 9: (3, None)}


def test_restored_tables_shuffle_lines_alone(tables):
    """Tables and their answers are put together where the lines of an order are numbered; null is an order like any other."""
    put, ask = tables
    rows = [(k, 1, 1, i, float(10 + i), 100.0 * i, 0.1, "RAN"[i % 3], "O") for k in (None, *range(1, 25)) for i in range(1 + (k or 0) % 5)]
    put("lineitem", rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    assert _shuffles(ask("restored_tables").select("error"), "Union", "Join") == 1


def test_heads_are_found_while_pages_are_read(spark):
    row = lambda *cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    tables = [
        row("a", "b", tag="th") + row("c", "1.5"), row("a", "b") + row("x", "12") + row("d", "e"), row("a", tag="th") + row("b") + row("c", tag="th"), row("a", tag="th") * 2,
        "<thead>" + row("1", "2") + "</thead>" + row("x", "y") + "<thead>" + row("z") + "</thead>", "<tr></tr>" + row("a", "\u0661") + row("v 2.5 w"), "<tr><td>a<table>" + row("1", tag="th") + "</table>b", row("a &amp; b", "&copy"),
        "<!-- no --><tr class='hi'><td COLSPAN=2 class=\"best x\">−1%<td><br/>z", "<tr><td><script>1 < 2</script>5", "<tr><td a='1'b='2'>1 < 2</td>", "",
    ]
    pages = [(k, f"<p>x</p><table>{t}</table><table>{row('7')}</table>") for k, t in enumerate(tables)] + [(90, None), (91, "<p>no")]
    frame = spark.createDataFrame(pages, "t int, html string")
    found, told = html_cells(frame, ["t"], "html", heads=True), with_heads(html_cells(frame, ["t"], "html"), ["t", "table"])
    assert _shuffles(found) == 0
    names = ["t", "table", "head", "thead", "r", "k", "th", "best", "hi", "colspan", "rowspan", "text"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rows(found) == rows(told) and len({r[0] for r in rows(found)}) == len(tables)
    parsed = lambda text: (p := _Cells(), p.feed(text), p.close(), p.out)[-1]
    assert all(_page_cells(html or "") == parsed(html or "") for _, html in pages)


def test_recognised_pages_take_one_shuffle_of_words(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    at = [20.0, 80.0, 140.0, 330.0, 400.0, 460.0]
    # the second page has one row in two columns only, the third a word over the middle
    words = [(1, p, 0, i, x, 20.0 * i, x + (250 if p == 3 and x == 140 else 45), 20.0 * i + 10, f" {x:.0f} ") for p, n in ((1, 3), (2, 1), (3, 3)) for i in range(n) for x in at]
    out = recognised_lines(spark.createDataFrame(words, f"doc_id int, page int, block int, line int, {box}, text string"), spark.createDataFrame([(1, p, 600.0) for p in (1, 2, 3)], "doc_id int, page int, width double").hint("broadcast"))
    assert _shuffles(out, "Window", "Aggregate") == 1
    got = {p: [(r["line"], r["part"], r["columns"], r["text"]) for r in sorted(out.filter(f"page = {p}").collect(), key=lambda r: r["place"])] for p in (1, 2, 3)}
    assert got[1] == [(i, k, True, ("20 80 140", "330 400 460")[k]) for k in (0, 1) for i in range(3)]
    assert got[2] == [(0, 0, False, "20 80 140 330 400 460")] and [g[:3] for g in got[3]] == [(i, 0, False) for i in range(3)]


def test_lines_of_equations_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [(d, 1, 100.0, 100.0 * i, 560.0, 100.0 * i + 8, f"y = {i} ({i})", False) for d in range(40) for i in range(1, 6)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, heading boolean").withColumn("text", told("text"))
    out = equations(lines, spark.createDataFrame([(d, 1, 600.0, False) for d in range(40)], "doc_id int, page int, width double, two_columns boolean")).collect()
    assert len(out) == 200 and all(r["text"] == f"y = {r['n']} ({r['n']})" for r in out)
    assert seen.value == 200


def test_equations_take_one_shuffle(spark, tables):
    """Numbers among prose, other numbers and two columns; a page without a size and one with two; lines that are together are not shuffled again."""
    put, ask = tables
    at = [(100, 10, 300, 20, "a"), (60, 22, 560, 30, "b (1)"), (60, 24, 560, 32, "c (2)"), (60, 44, 560, 52, "where we have as before (7)"), (60, 46, 290, 54, "d (3)"), (310, 46, 560, 54, "e (4)"), (100, 60, 500, 70, "f (5)"), (None, 26, 80, 34, "g")]
    lines = spark.createDataFrame([(d, 1, *map(lambda v: v if v is None else float(v), b[:4]), b[4], False) for d in (1, 2, 3, 4) for b in at], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, heading boolean")
    pages = spark.createDataFrame([(1, 1, 600.0, False), (2, 1, 600.0, True), (4, 1, 600.0, False), (4, 1, 600.0, False)], "doc_id int, page int, width double, two_columns boolean")
    out = equations(lines, pages)
    assert _shuffles(out, "Join", "Window", "Aggregate") == 1
    got = {d: sorted((r["n"], r["text"], r["x0"], r["y0"], r["y1"]) for r in out.collect() if r["doc_id"] == d) for d in (1, 2, 3, 4)}
    assert got[1] == [("1", "a b (1)", 60.0, 10.0, 30.0), ("2", "c (2) g", 60.0, 24.0, 34.0), ("4", "d (3) e (4)", 60.0, 46.0, 54.0)]
    assert got[2] == [("1", "a b (1)", 60.0, 10.0, 30.0), ("2", "c (2) g", 60.0, 24.0, 34.0), ("3", "d (3)", 60.0, 46.0, 54.0), ("4", "e (4)", 310.0, 46.0, 54.0)]
    assert got[3] == [] and [g[:2] for g in got[4][:2]] == [("1", "a a b (1) b (1)")] * 2
    put("lineitem", [(k, 1, 1, i, float(q), 10.0 * q, 0.1, "R", "O") for k in (1, 2, None) for i, q in enumerate((11, 10, 12))], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    assert _shuffles(ask("equation_lines").select("n"), "Join") == 1


def test_grids_are_checked_where_they_are_placed(spark):
    """Faults and counts equal those of the squares, for keys that end with a batch, go over several and are null; one shuffle."""
    rng = random.Random(3)
    cells = [(t if t else None, r, k, "x", rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2])) for t in range(60) for r in range(rng.randrange(1, 4)) for k in range(rng.randrange(1, 4))]
    cells += [(100, r, k, "x", 300, 1) for r in range(40) for k in range(3)] + [(101, 0, 0, "x", 1, 1), (101, 0, 1, "x", 1, 2), (101, 1, 0, "x", 2, 1)]
    frame = spark.createDataFrame(cells, "t long, r int, k int, text string, colspan int, rowspan int")
    squares = grids.place_cells(frame, "t")
    counts = {r["t"]: r["count"] for r in squares.groupBy("t").count().collect()}
    faults = {r["t"]: r["fault"] for r in grids.grid_faults(squares, "t").collect()}
    checked = grids.check_grids(frame, "t")
    got = checked.collect()
    assert len(got) == len(counts) and set(faults.values()) == {"overlap", "ragged", "gap", None}
    assert {r["t"]: (r["squares"], r["fault"]) for r in got} == {t: (counts[t], faults[t]) for t in counts}
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_table_grid_shuffles_lines_once(spark):
    plan = QUERIES["table_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rejoined_paragraphs_read_documents_once(spark):
    """The lines are cut once; every later step reads what that made."""
    plan = QUERIES["rejoined_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "split(" not in plan


def test_paragraphs_take_one_shuffle_of_lines(spark):
    """Boxes, notes and joined rows of a document are told apart in one pass; items that are together are not shuffled."""
    at = {"in": (60.0, 200.0, 80.0, 210.0), "half": (40.0, 200.0, 60.0, 210.0), "p": (50.0, 30.0, 500.0, 90.0), "fig": (50.0, 100.0, 500.0, 400.0)}
    rows = [
        (1, 0, "p", 1, "one", "p"), (1, 1, "fig", 1, None, "fig"), (1, 2, "p", 1, "axis", "in"), (1, 3, "p", 1, "* note", "p"), (1, 4, None, 1, "unknown", "p"), (1, 5, "p", 2, "two,", "p"), (1, 6, "p", 3, "three", "p"),
        (2, 0, "li", 1, "item", "p"), (2, 1, "tab", 2, "", "fig"), (2, 2, "p", 2, "half", "half"), (2, 3, "p", None, "lost", "p"),
        (None, 0, "p", 1, "a", "p"), (None, 1, "fig", 1, "f", "fig"), (None, 2, "p", 1, "axis", "in"),
    ]
    frame = spark.createDataFrame([(*r[:5], *at[r[5]]) for r in rows], "doc_id bigint, ord bigint, type string, page bigint, text string, x0 double, y0 double, x1 double, y1 double")
    out = rejoined(frame)
    assert _shuffles(out, "Join", "Window", "Aggregate") == 1
    want = [
        (1, 0, "p", 1, "one two,"), (1, 1, "fig", 1, ""), (1, 2, "p", 1, "axis"), (1, 3, "p", 1, "* note"), (1, 4, None, 1, "unknown"), (1, 6, "p", 3, "three"),
        (2, 0, "li", 1, "item half"), (2, 1, "tab", 2, ""), (2, 3, "p", None, "lost"), (None, 0, "p", 1, "a axis"), (None, 1, "fig", 1, "f"),
    ]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert _shuffles(QUERIES["rejoined_paragraphs"](spark, "/root/testdata/sf0.001"), "Join", "Window", "Aggregate") == 1
