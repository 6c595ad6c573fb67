"""Tables, pictures, equations, paragraphs and articles against loops over literal and random cases."""

from __future__ import annotations

import random


from folium.functions import article
from folium.operators import artwork, layout, tables


def loops_of_boxes(boxes, pad=3):
    """Boxes joined while any two lie nearer than pad, one pair at a time."""
    now = [list(b) for b in boxes]
    changed = True
    while changed:
        changed = False
        for i in range(len(now)):
            for j in range(i + 1, len(now)):
                a, b = now[i], now[j]
                if a[0] - pad < b[2] and b[0] < a[2] + pad and a[1] - pad < b[3] and b[1] < a[3] + pad:
                    now[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
                    del now[j]
                    changed = True
                    break
            if changed:
                break
    return sorted(tuple(b) for b in now)


def test_clusters_equal_loops(spark):
    rng = random.Random(4)
    rows = []
    for page in range(12):
        for _ in range(rng.randint(1, 45)):
            x, y = rng.uniform(-50, 600), rng.uniform(0, 800)
            rows.append((1, page, x, y, x + rng.uniform(1, 70), y + rng.uniform(1, 50), rng.randint(0, 4)))
    # a long chain of tiles, the same box twice, boxes that just don't touch
    rows += [(1, 99, 10.0 * i, 0.0, 10.0 * i + 9, 9.0, 1) for i in range(200)] + [(2, 1, 0.0, 0.0, 5.0, 5.0, 1)] * 2 + [(2, 2, 0.0, 0.0, 5.0, 5.0, 1), (2, 2, 8.0, 0.0, 12.0, 5.0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, segments long")
    got: dict = {}
    for r in artwork.clusters(frame).collect():
        got.setdefault((r["doc_id"], r["page"]), []).append((r["x0"], r["y0"], r["x1"], r["y1"], r["segments"]))
    pages = {(r[0], r[1]) for r in rows}
    assert {p: sorted(b) for p, b in got.items()} == {p: loops_of_boxes([r[2:] for r in rows if (r[0], r[1]) == p]) for p in pages}
    assert len(got[1, 99]) == 1 and len(got[2, 2]) == 2
    assert artwork.clusters(frame.filter("false")).count() == 0


def test_clusters_need_no_rounds(spark, monkeypatch):
    # each box touches only what the ones before have grown to; boxes without a place stay as they are
    def kept(df):
        raise AssertionError("rows are kept for another round")

    monkeypatch.setattr(artwork, "settled", kept)
    steps = [(1, 1, 0.0, 0.0, 10.0, 10.0, 1)]
    for k in range(300):
        steps.append((1, 1, steps[-1][4] + 2, -20.0 * (k + 1), steps[-1][4] + 6, -20.0 * k + 1, 1))
    rng = random.Random(5)
    rng.shuffle(steps)
    odd = [(1, 1, None, 0.0, 5.0, 5.0, 1), (1, 1, float("nan"), 0.0, 5.0, 5.0, 1), (None, 1, 0.0, 0.0, 5.0, 5.0, 1), (None, 1, 0.0, 0.0, 5.0, 5.0, None)]
    frame = spark.createDataFrame(steps + odd, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, segments int")
    got = artwork.clusters(frame)
    assert dict(got.dtypes)["segments"] == "bigint"
    rows = got.collect()
    assert len(rows) == 5 and sorted(str(r["segments"]) for r in rows) == ["1", "1", "1", "301", "None"]


def test_standalone_artwork_of_a_page(spark, monkeypatch):
    def kept(df):
        raise AssertionError("rows are kept between steps")

    monkeypatch.setattr(artwork, "settled", kept)
    box = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"
    two = lambda *b: [(1, p, *map(float, b)) for p in (1, 2, 3)]
    # two halves, a part of them, a scrap, one over the edge, one that is used already; page 3 has no size, page 4 no row
    pictures = two(100, 100, 200, 150) + two(100, 151, 200, 200) + two(-10, 300, 60, 340) + two(0, 500, 20, 500) + two(300, 300, 360, 360) + [(1, 4, 0.0, 0.0, 90.0, 90.0)]
    strokes = [(*b, 2) for b in two(110, 110, 140, 140) + two(142, 110, 180, 180) + two(400, 400, 470, 440) + two(471, 400, 480, 440) + two(0, 700, 600, 790)] + [(*b, 9) for b in two(300, 100, 380, 180)]
    taken = two(290, 290, 360, 360)
    prose = [(*b, n, 1) for n, b in zip((30, 30, 30, 20, 20, 20), two(305, 105, 340, 120) + two(305, 121, 340, 140), strict=True)]
    prose += [(1, 2, 305.0, 141.0, 340.0, 150.0, 6, 1)]
    pages = [(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0), (1, 3, None, 800.0)]
    got = artwork.standalone(
        spark.createDataFrame(pictures, box), spark.createDataFrame(strokes, f"{box}, segments long"), spark.createDataFrame(taken, box),
        spark.createDataFrame(prose, f"{box}, chars int, block int"), spark.createDataFrame(pages, "doc_id long, page int, width double, height double"),
    )
    found: dict = {}
    for r in got.collect():
        found.setdefault(r["page"], set()).add((r["x0"], r["y0"], r["x1"], r["y1"]))
    both = {(100.0, 100.0, 200.0, 200.0), (0.0, 300.0, 60.0, 340.0)}
    drawn = {(399.5, 399.5, 480.5, 440.5)}
    assert found == {1: both | drawn | {(299.5, 99.5, 380.5, 180.5)}, 2: both | drawn, 3: both}


def grid_fault(cells):
    """cells: (head, r, k, colspan, rowspan); the first thing wrong with a table, placed square by square."""
    heads = max((r + 1 for h, r, *_ in cells if h), default=0)
    rows = heads + max((r + 1 for h, r, *_ in cells if not h), default=0)
    placed = sorted((r + (0 if h else heads), k, c, s) for h, r, k, c, s in cells)
    if any(c > 200 or c < 1 or s < 1 or s > rows - r for r, _, c, s in placed):
        return "span"
    taken, at = {}, {}
    for r, _, c, s in placed:
        col = at.get(r, 0)
        while (r, col) in taken:
            col += 1
        for j in range(col, col + c):
            for i in range(r, r + s):
                taken[i, j] = taken.get((i, j), 0) + 1
        at[r] = col + c
    if max(taken.values()) > 1:
        return "overlap"
    widths = {r: [j for i, j in taken if i == r] for r in range(rows)}
    if any(max(w, default=-1) + 1 != len(w) for w in widths.values()):
        return "gap"
    if len({len(w) for w in widths.values()}) != 1:
        return "ragged"
    return "leak" if any(h and s > heads - r for h, r, _, _, s in cells) else None


def test_faults_equal_loops(spark):
    rng = random.Random(9)
    made = {}
    for t in range(120):
        heads, body, wide = rng.randint(0, 2), rng.randint(1, 4), rng.randint(1, 4)
        cells = [(i < heads, i if i < heads else i - heads, k, 1, 1) for i in range(heads + body) for k in range(wide)]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(cells))
            h, r, k, c, s = cells[i]
            cells[i] = (h, r, k, rng.choice([1, 2, 3]), rng.choice([1, 1, 2]))
        if rng.random() < 0.3 and len(cells) > 1:
            h, r, k, *_ = cells.pop(rng.randrange(len(cells)))
        # rows that lost all their cells make no table
        if {(h, r) for h, r, *_ in cells} == {(i < heads, i if i < heads else i - heads) for i in range(heads + body)}:
            made[t] = cells
    made[200] = [(True, 0, 0, 1, 2), (True, 0, 1, 1, 1), (False, 0, 0, 1, 1)]
    made[201] = [(False, 0, 0, 1, 1), (False, 0, 1, 1, 2), (False, 1, 0, 2, 1)]
    frame = spark.createDataFrame([(t, *c, "x") for t, cells in made.items() for c in cells], "t int, head boolean, r int, k int, colspan int, rowspan int, text string")
    got = {r["t"]: r["fault"] for r in tables.table_faults(frame, ["t"]).collect()}
    want = {t: grid_fault(cells) for t, cells in made.items()}
    assert got == want and {"overlap", "ragged", "leak", "span", None} <= set(want.values())


WORDS = "t int, x0 double, y0 double, x1 double, y1 double, text string"


def test_figures_without_rules(spark):
    """No rule ends the head; too few columns or rows make no table; labels without rules share rows at their middles."""
    cells = [(t, 60.0 * c, 0.0, 60.0 * c + 60, 200.0) for t, n in ((1, 4), (2, 3), (3, 4)) for c in range(n)]
    words = [(t, 125.0 + 60 * c, 50.0 + 20 * r, 140.0 + 60 * c, 60.0 + 20 * r, f"{r}.{c}") for t, n in ((1, 6), (2, 6), (3, 2)) for r in range(n) for c in range(2)]
    words += [(1, 5.0, 50.0 + 20 * r, 40.0, 60.0 + 20 * r, f"L{r}") for r in (0, 4)] + [(1, 70.0, 30.0, 110.0, 40.0, "Kind")]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = tables.score_tables(
        one(cells, WORDS.replace(", text string", "")), one(words, WORDS), one([], "t int, x0 double, x1 double, y double"),
        one([(t, 0.0, 200.0, 240.0) for t in (1, 2, 3)], "t int, y0 double, y1 double, width double"), one([], WORDS), "t",
    ).collect()
    assert {r["t"] for r in out} == {1}
    labels = {(r["text"], r["r"], r["rowspan"]) for r in out if not r["head"] and r["text"].startswith("L")}
    assert labels == {("L0", 0, 3), ("L4", 3, 3)}
    assert sorted((r["k"], r["text"], r["colspan"], r["rowspan"]) for r in out if r["head"]) == [(0, "", 1, 1), (1, "Kind", 1, 1), (2, "", 1, 1), (3, "", 1, 1)]
    assert {r["text"] for r in out if r["numeric"]} == {f"{r}.{c}" for r in range(6) for c in range(2)}


def test_words_at_line_ends(spark):
    rows = [
        (1, 0, "ap- plying it, and applying zero- shot rules; pre- and post- training."),
        (1, 1, "Human- centric work: human work is centric. detec- tion <b>to-</b> <b>kens</b> <i>a-</i> <b>b</b> GPT- based x"),
        (1, 2, None), (1, 3, ""), (2, 0, "zero- shot is zero-shot"), (1, 0, "ap- plying it, and applying zero- shot rules; pre- and post- training."),
    ]
    got = {(r["doc_id"], r["ord"]): r["text"] for r in layout.mended(spark.createDataFrame(rows[:5], "doc_id int, ord int, text string")).collect()}
    assert got[1, 0] == "applying it, and applying zero-shot rules; pre- and post-training."
    assert got[1, 1] == "Human-centric work: human work is centric. detection <b>tokens</b> <i>a-</i><b>b</b> GPT-based x"
    assert got[1, 2] is None and got[1, 3] == "" and got[2, 0] == "zero-shot is zero-shot"


def test_articles():
    page = lambda body: f"<article class='ltx_document'><p>text</p>{body}</article>"
    kinds = lambda body: [(r["type"], r.get("fallback")) for r in article.read_article(page(body))[2:]]
    refused = [{"type": "refused"}]
    assert article.read_article(None) == article.read_article("<p>x</p>") == refused
    assert article.read_article("<article class='ltx_document'><h2 class='ltx_title ltx_title_section'>only</h2></article>") == refused
    for body in ("<p><svg></svg></p>", "<math><mi>x</mi></math>", "<p>a<table><tr><td>1</td></tr></table></p>", "<div class='ltx_equation'></div>"):
        assert article.read_article(page(body)) == refused or body.startswith("<p>a<table>")
    assert kinds("<figure><svg></svg><figcaption>Figure 2: a</figcaption></figure>") == [("fig", "html_structure")]
    assert kinds("<figure><figcaption>Figure 2: a</figcaption></figure>") == [("fig", None)]
    assert kinds("<figure>loose<figcaption>Figure 2: a</figcaption></figure>") == [("fig", "html_structure")]
    assert kinds("<table><caption>Table 1</caption><tr><td><img></td></tr></table>") == [("tab", "html_structure")]
    assert kinds("<table><tr><td><table></table></td></tr></table>") == [("tab", "html_structure")]
    assert kinds("<figure><figure><img class='ltx_graphics' src='a'></figure><figure><img class='ltx_graphics' src='b'></figure></figure>") == [("fig", None)] * 2
    rows = article.read_article(page("<section><h3 class='ltx_title ltx_title_subsection'><span class='ltx_tag'>2.1.</span> A <em>b</em></h3><p>x<br>y</p></section>"))
    assert rows[2]["n"] == "2.1" and rows[2]["text"] == "A <i>b</i>" and rows[3]["section"] == ["2.1"] and rows[3]["text"] == "x<br/>y"
    assert article.read_article(page("<div>" * 5000 + "<p>x</p>")) == refused


def test_imports(spark):
    base = "https://p.example/html/"
    block = lambda paper, ord, kind="p", urls=None, fallback=None: (paper, ord, kind, urls, fallback)
    blocks = [
        block("a1", 0), block("b1v2", 0, "fig", ["b1v2/x.png", "/html/b1v2/y.png"]), block("c1", 0, "fig", ["c1v1/x"]), block("c1", 1, "fig", [f"{base}c1v2/x"]),
        block("d1v1", 0, "fig", ["d1v2/x"]), block("e1v1", 0, "fig", None, "html_structure"), block("f1v1", 0, "fig", None, "html_structure"),
        block("g1", 0, "fig", ["https://other.example/html/g1v7/x", "../g1v8/x", "g1v3/x"]), block("h1", -1, "refused"), block("k1", 0, "fig", None, "html_structure"),
    ]
    papers = [(p, "x") for p in ("a1", "b1v2", "c1", "d1v1", "e1v1", "f1v1", "g1", "h1", "k1")] + [("i1", None)]
    frame = spark.createDataFrame(blocks, "paper string, ord long, type string, urls array<string>, fallback string")
    found = spark.createDataFrame([("e1v1", 0), ("k1", 0)], "paper string, ord long")
    got = {r["paper"]: (r["source"], r["kind"], r["reason"]) for r in article.imported(spark.createDataFrame(papers, "paper string, html string"), frame, found, base).collect()}
    assert got == {
        "a1": ("a1", "html", None), "b1v2": ("b1v2", "html", None), "c1": ("c1", "pdf", "html_images"), "d1v1": ("d1v1", "pdf", "html_images"), "e1v1": ("e1v1", "mixed", None),
        "f1v1": ("f1v1", "pdf", "html_structure"), "g1": ("g1v3", "html", None), "h1": ("h1", "pdf", "html_structure"), "i1": ("i1", "pdf", "html_unavailable"), "k1": ("k1", "pdf", "html_structure"),
    }


def test_styled_lines_as_rows_and_arrays(spark):
    """Whole lines need no shuffle; both forms give the same."""
    lines = {
        1: [(10.0, 0, 100.0, "a < b  "), (6.0, 0, 103.0, " 2 "), (10.0, 18, 100.0, " bold "), (6.0, 0, 97.0, "up"), (6.0, 0, 100.5, " small"), (10.0, 1, 100.0, "flag "), (10.0, 0, 0.0, " \t")],
        2: [(10.0, 1, 50.0, "only"), (6.0, 0, 80.0, "x")],
        3: [(10.0, 0, 100.0, " \n"), (6.0, 0, 100.0, "y"), (6.0, 0, 90.0, "longest"), (5.0, 0, 91.0, "z")],
        4: [(10.0, 0, 100.0, "a"), (10.0, 0, 100.0, None)],
        5: [],
    }
    want = {1: "a &lt; b<sub>2</sub><i><b> bold </b></i><sup>up</sup> small<sup>flag</sup>", 2: "<sup>only</sup>x", 3: "ylongest<sub>z</sub>", 4: None}
    kind = "size double, flags int, y double, text string"
    whole = spark.createDataFrame([(k, v) for k, v in lines.items()], f"id int, spans array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    flat = spark.createDataFrame([(k, i, *p) for k, v in lines.items() for i, p in enumerate(v)], f"id int, k int, {kind}")
    styled = layout.styled_lines(whole, ["id"])
    assert "Exchange" not in styled._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["text"] for r in styled.collect()} == want
    assert {r["id"]: r["text"] for r in layout.styled_lines(flat.repartition(3), ["id"]).collect()} == want


def test_mended_words_are_shuffled_once(spark):
    rows = [(1, 0, "an ap- plying of cross- domain text"), (1, 1, "we are applying Ker- nel"), (2, 0, "ap- plying applying"), (None, 0, "ap- plying"), (3, 0, None), (3, 1, "x" * 5000 + "- y &lt;b> <b>co-</b> <b>de</b> code")]
    got = layout.mended(spark.createDataFrame(rows, "doc_id int, ord int, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = {(1, 0): "an applying of cross-domain text", (1, 1): "we are applying Kernel", (2, 0): "applying applying", (None, 0): "ap- plying", (3, 0): None, (3, 1): "x" * 5000 + "y &lt;b> <b>code</b> code"}
    assert {(r["doc_id"], r["ord"]): r["text"] for r in got.collect()} == want


def test_faults_are_found_in_one_shuffle(spark):
    cells = [(1, True, 0, 0, 1, 1), (1, False, 0, 0, 1, 1), (2, False, 0, 0, 1, None), (3, True, 0, 0, 1, 2), (3, False, 0, 0, None, 1), (4, False, 0, 0, None, 9), (None, False, 0, 0, 201, 1)]
    faults = tables.table_faults(spark.createDataFrame(cells, "t int, head boolean, r int, k int, colspan int, rowspan int"), ["t"])
    plan = faults._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {r["t"]: r["fault"] for r in faults.collect()} == {1: None, 2: None, 3: "leak", 4: "span", None: "span"}


def test_ruled_tables_are_laid_out_in_one_shuffle(spark):
    # sides are a little apart, a cell is told twice, a side lies in the middle of two edges, a table has no name
    cells = [(1, 0.0, 0.0, 60.0, 20.0, "He\nad"), (1, 0.5, 20.0, 30.4, 40.0, " 1.5% "), (1, 30.0, 20.5, 60.0, 40.0, "b"), (1, 30.0, 20.5, 60.0, 40.0, "a"), (1, 30.0, 20.5, 60.0, 40.0, None), (None, 0.0, 0.0, 1.0, 1.0, "x")]
    got = tables.ruled_tables(spark.createDataFrame(cells, "t int, x0 double, y0 double, x1 double, y1 double, text string"), "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, True, 0, 0, "He ad", 2, 1, False), (1, False, 0, 0, "1.5%", 1, 1, True), (1, False, 0, 1, "a", 1, 1, False)}


def test_articles_of_plain_tags_need_no_general_parser(monkeypatch):
    """The short path builds the tree of the general parser, or leaves a page to it."""
    rng = random.Random(8)
    told = lambda n: (n.tag, n.attrs, ["".join(k) if t else told(k[0]) for t, k in grouped(n.kids)])

    def grouped(kids):
        out: list = []
        for k in kids:
            if isinstance(k, str) and out and out[-1][0]:
                out[-1][1].append(k)
            else:
                out.append((isinstance(k, str), [k]))
        return out

    def general(page):
        tree = article._Tree()
        tree.feed(page)
        tree.close()
        return tree.root

    parts = ["<p>", "</p>", "<b class='x y'>", "</b>", '<img src="a.png">', "<br>", "<br/>", "a &lt; b", "&amp", " x &#41; ", "<math alttext='x&lt;1'>", "</math>", "<i title='a&b'>", "<script>s() && '</script>", "<script>a<b</script>", "<title>a<b>c</title>", "1 < 2", "<P ID=q>", "<!-- c -->", "&nbsp;", "\n"]
    for _ in range(1500):
        page = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert told(article._tree(page)) == told(general(page)), page
    monkeypatch.setattr(article._Tree, "feed", lambda *_: 1 / 0)
    whole = "<article class='ltx_document'><h1 class='ltx_title ltx_title_document'>T &amp; t</h1><p>one <math alttext='x&lt;1'></math><script>s()</script></p></article>"
    assert [r.get("text") for r in article.read_article(whole)] == ["T & t".replace("&", "&amp;"), r"one \(x&lt;1\)"]
