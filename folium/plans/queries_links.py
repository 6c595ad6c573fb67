"""Record linkage, passages, tables of cells, pages, rectangles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.functions.html import html_blocks
from folium.operators import grids
from folium.operators.relations import link_unique, locate, missing_tokens, overlap, words_of
from folium.sources.tables import blocks, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()


@query("exact_duplicates", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    """Contents that several documents have; the first stays at ingestion."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


def _sides(spark, sf_dir):
    b = blocks(table(spark, sf_dir, "documents")).withColumn("sig", F.sha2(T.normal(F.col("text")), 256)).select("doc_id", F.col("ord").alias("id"), "type", "sig")
    #: The newer extraction lacks every seventh block.
    return b, b.filter("(id + doc_id) % 7 <> 0")


_DIFF = f"""{BLOCKS}, o AS (SELECT doc_id, ord AS id, type, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS sig FROM blocks), n AS (SELECT * FROM o WHERE (id + doc_id) % 7 <> 0),
o1 AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY doc_id, type, sig) = 1), n1 AS (SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY doc_id, type, sig) = 1),
same AS (SELECT o1.doc_id, o1.type, o1.id AS old_id, n1.id AS new_id, 'same' AS kind FROM o1 JOIN n1 USING (doc_id, type, sig)),
diff AS (SELECT * FROM same UNION ALL SELECT doc_id, type, id, NULL, 'missing' FROM o ANTI JOIN same ON same.doc_id = o.doc_id AND same.type = o.type AND same.old_id = o.id
  UNION ALL SELECT doc_id, type, NULL, id, 'added' FROM n ANTI JOIN same ON same.doc_id = n.doc_id AND same.type = n.type AND same.new_id = n.id)"""


@query("signature_diff", f"WITH {_DIFF} SELECT * FROM diff")
def signature_diff(spark, sf_dir):
    return link_unique(*_sides(spark, sf_dir), ["doc_id", "type"], "sig")


@query("change_counts", f"WITH {_DIFF} SELECT doc_id, CAST(sum((kind = 'same')::INT) AS BIGINT) AS same, CAST(sum((kind = 'missing')::INT) AS BIGINT) AS missing, CAST(sum((kind = 'added')::INT) AS BIGINT) AS added FROM diff GROUP BY doc_id")
def change_counts(spark, sf_dir):
    d = link_unique(*_sides(spark, sf_dir), ["doc_id", "type"], "sig")
    return d.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("same", "missing", "added")))


@query(
    "passage_location",
    "WITH b AS (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS p FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents), h AS (SELECT item_id, count(*) AS n, min(doc_id) AS one FROM b JOIN d ON contains(t, p) GROUP BY item_id) SELECT item_id, CASE WHEN n = 1 THEN one END AS doc_id, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (item_id)",
)
def passage_location(spark, sf_dir):
    """The only document that contains a passage; none if there are several."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.normal(F.col("text")).alias("text"))
    return locate(items, table(spark, sf_dir, "documents").select("doc_id", T.normal(F.col("text")).alias("text")))


@query(
    "number_multiset_diff",
    r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS token FROM conversations),
    a AS (SELECT conv_id, turn, token, count(*) AS n FROM t GROUP BY ALL)
    SELECT a.conv_id, a.turn, CAST(sum(greatest(a.n - coalesce(b.n, 0), 0)) AS BIGINT) AS n FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.token = a.token GROUP BY a.conv_id, a.turn""",
)
def number_multiset_diff(spark, sf_dir):
    """Tokens of each message that the next one lacks, repeats counted."""
    w = words_of(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn").select("conv_id", "turn", "token")
    return missing_tokens(w, w.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


@query("state_fingerprint", "SELECT conv_id, sha256(string_agg(turn || '|' || role || '|' || text, chr(10) ORDER BY turn)) AS state FROM conversations GROUP BY conv_id")
def state_fingerprint(spark, sf_dir):
    """A hash of all ordered rows of a key; equal only if nothing has changed."""
    row = F.concat_ws("|", F.col("turn").cast("string"), "role", "text")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", row.alias("s")))).alias("rs"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("rs", lambda r: r["s"]), "\n"), 256).alias("state"))


#: Tags by place; a block's text goes from the tag that opens it to the next that opens or closes one.
_PAGE_BLOCKS = r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<(?:script|style|nav|footer)\b[^>]*>.*?</(?:script|style|nav|footer)>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, unnest(string_split(h, '<')) AS t, generate_subscripts(string_split(h, '<'), 1) AS i FROM s),
e AS (SELECT page_id, i, lower(regexp_extract(t, '^(/?[A-Za-z0-9]+)', 1)) AS tag, regexp_replace(t, '^[^>]*>', '') AS txt FROM t WHERE i > 1),
m AS (SELECT *, tag IN ('h1', 'h2', 'h3', 'p', 'li', 'pre', 'caption', 'figcaption') AS opens, tag IN ('/h1', '/h2', '/h3', '/p', '/li', '/pre', '/caption', '/figcaption', '/article', '/body', '/div', '/ul', '/ol', '/table') AS closes FROM e),
g AS (SELECT *, sum((opens OR closes)::INT) OVER (PARTITION BY page_id ORDER BY i) AS g FROM m),
b AS (SELECT page_id, g, arg_min(tag, i) AS tag, bool_or(opens) AS opens, string_agg(CASE WHEN tag = 'br' THEN ' ' ELSE '' END || txt, '' ORDER BY i) AS txt FROM g GROUP BY page_id, g),
d AS (SELECT page_id, g, CASE tag WHEN 'h1' THEN 'sec' WHEN 'h2' THEN 'sub' WHEN 'h3' THEN 'ssub' WHEN 'li' THEN 'li' ELSE 'p' END AS type, trim(regexp_replace(replace(replace(replace(replace(replace(txt, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM b WHERE opens)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS ord, type, text FROM d WHERE text <> ''"""


@query("html_page_blocks", _PAGE_BLOCKS)
def html_page_blocks(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("page_links", "SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def page_links(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query("best_cells", "SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS col, l_quantity FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AND count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3) >= 2")
def best_cells(spark, sf_dir):
    """Of each order's table (rows: lines, columns: supplier groups), the largest numbers of a column."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("col"), "l_quantity")
    return grids.best_cells(li, "l_orderkey", "col", F.col("l_quantity"))


@query(
    "table_grid",
    """WITH n AS (SELECT l_orderkey, 1 + l_partkey % 2 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    f AS (SELECT l_orderkey, n, w, i, i // 3 AS r, max(w) FILTER (i = 0) OVER (PARTITION BY l_orderkey) AS w0 FROM n),
    wide AS (SELECT l_orderkey, n, sum(w) + CASE WHEN r = 1 THEN max(w0) ELSE 0 END AS wide, sum(w * CASE WHEN n > 3 AND i = 0 OR n = 4 AND i = 2 THEN 2 ELSE 1 END) AS squares, max(w) FILTER (i = 1) AS w1, max(w) FILTER (i = 3) AS w3 FROM f GROUP BY l_orderkey, n, r)
    SELECT l_orderkey, CAST(sum(squares) AS BIGINT) AS squares, CASE WHEN n = 4 THEN CASE WHEN max(w3) > max(w1) THEN 'overlap' WHEN max(w3) < max(w1) THEN 'gap' END WHEN min(wide) <> max(wide) THEN 'ragged' END AS fault FROM wide GROUP BY l_orderkey, n""",
)
def table_grid(spark, sf_dir):
    """Each order as a table of rows of three cells, placed on a grid and checked; the first cell reaches down a row, of four cells the third as well."""
    w = Window.partitionBy("l_orderkey")
    i = F.row_number().over(w.orderBy("l_linenumber", "l_partkey")) - 1
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", i.alias("i"), F.count("*").over(w).alias("n"), (F.col("l_partkey") % 2 + 1).alias("colspan"))
    down = ((F.col("n") > 3) & (F.col("i") == 0)) | ((F.col("n") == 4) & (F.col("i") == 2))
    cells = li.select("l_orderkey", F.floor(F.col("i") / 3).alias("r"), (F.col("i") % 3).alias("k"), "colspan", F.when(down, 2).otherwise(1).alias("rowspan"))
    # the windows have brought the lines of an order together
    return grids.check_grids(cells, "l_orderkey", dealt=True)


@query("numeric_conflicts", "SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity <> l_quantity + (CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey")
def numeric_conflicts(spark, sf_dir):
    """Cells whose numbers differ between two versions of a table."""
    # both versions number the lines for themselves; equal lines but for the quantity must come in one order
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("r"), F.lit(0).alias("c"), "l_quantity")
    as_text = lambda x: li.select("l_orderkey", "r", "c", x.cast("string").alias("text"))
    changed = F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)
    return grids.conflicts(as_text(F.col("l_quantity")), as_text(changed), "l_orderkey", T.numbers)


_RECT = "l_orderkey AS page, l_linenumber AS k, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 20 AS x1, l_discount * 100 + 5 AS y1"


@query(
    "image_coverage",
    f"WITH r AS (SELECT {_RECT} FROM lineitem), i AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k > 1) SELECT page, k FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = i.page AND greatest(least(i.x1, b.x1) - greatest(i.x0, b.x0), 0) * greatest(least(i.y1, b.y1) - greatest(i.y0, b.y0), 0) >= 0.55 * (i.x1 - i.x0) * (i.y1 - i.y0))",
)
def image_coverage(spark, sf_dir):
    """Images of which no stored region of the page covers 55 percent."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 100 + 5).alias("y1"))
    i, b = r.filter("k = 1").alias("i"), r.filter("k > 1").alias("b")
    covered = (F.col("i.page") == F.col("b.page")) & (overlap("i", "b") >= 0.55 * (F.col("i.x1") - F.col("i.x0")) * (F.col("i.y1") - F.col("i.y0")))
    return i.join(b, covered, "left_anti").select("page", "k")


@query("box_union", f"SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM (SELECT {_RECT} FROM lineitem) GROUP BY page")
def box_union(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 100 + 5).alias("y1"))
    return r.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


@query("body_font", "SELECT source, arg_max(size, (w, -size)) AS body FROM (SELECT source, length(text) % 7 + 8 AS size, sum(length(text)) AS w FROM documents WHERE length(text) > 45 GROUP BY ALL) GROUP BY source")
def body_font(spark, sf_dir):
    """The weighted mode of sizes (of texts), ties to the smaller."""
    d = table(spark, sf_dir, "documents").select("source", F.length("text").cast("bigint").alias("n")).filter("n > 45")
    g = d.groupBy("source", (F.col("n") % 7 + 8).alias("size")).agg(F.sum("n").alias("w"))
    return g.groupBy("source").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))


@query("repeated_furniture", f"WITH {BLOCKS}, e AS (SELECT b.doc_id, b.text, d.source FROM blocks b JOIN documents d USING (doc_id) JOIN (SELECT doc_id, max(ord) AS last FROM blocks GROUP BY doc_id) m USING (doc_id) WHERE ord = 0 OR ord = last) SELECT source, text, count(DISTINCT doc_id) AS docs FROM e GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def repeated_furniture(spark, sf_dir):
    """First and last lines that several documents of a source share."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("l"))
    e = d.select("doc_id", "source", F.explode(F.array_distinct(F.array(F.get("l", F.lit(0)), F.element_at("l", -1)))).alias("text"))
    return e.groupBy("source", "text").agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 2")
