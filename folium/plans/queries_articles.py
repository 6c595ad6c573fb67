"""Articles written as LaTeXML writes them, from the lines of documents: blocks, and where a paper's blocks come from. SQL gives what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import article
from folium.operators import tables
from folium.sources.tables import blocks, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

_BASE = "https://papers.example.org/html/"

#: Lines with text, by number from 1, and what a line is in the article: every tenth from the third on a section, a subsection after it, and so on.
_WRITTEN = f"""{BLOCKS}, w AS (SELECT doc_id, ord, trim(text, ' ' || chr(9) || chr(13)) AS t, replace(replace(replace(trim(text, ' ' || chr(9) || chr(13)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM blocks),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM w WHERE regexp_matches(t, '\\S')),
k AS (SELECT *, (i - 1) % 10 AS j, (i - 1) // 10 + 1 AS g FROM l),
read AS (SELECT DISTINCT doc_id FROM k WHERE doc_id % 6 <> 1 AND doc_id % 6 <> 2)"""


def _number() -> Column:
    """The paper's id: five digits at least (lpad would cut longer ones)."""
    return F.format_string("9901.%05d", F.col("doc_id"))


def _written(spark, sf_dir) -> DataFrame:
    """doc_id, html: every line is a part of the article by its number; of six documents, one has no article, one draws within its text."""
    line = F.expr("trim(BOTH ' \t\r' FROM text)")
    lines = blocks(table(spark, sf_dir, "documents")).select("doc_id", "ord", line.alias("t")).filter(F.col("t").rlike(r"\S"))
    e = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    n = lines.select("doc_id", "ord", e.alias("e"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("i"))
    n = n.withColumn("j", (F.col("i") - 1) % 10).withColumn("g", (F.floor((F.col("i") - 1) / 10) + 1).cast("string"))
    kind, g, e = F.col("doc_id") % 6, F.col("g"), F.col("e")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    html = (
        F.when(F.col("j") == 2, put("<section><h2 class='ltx_title ltx_title_section'><span class='ltx_tag'>", g, ".</span> ", e, "</h2></section>"))
        .when(F.col("j") == 3, put("<h3 class='ltx_title ltx_title_subsection'><span class='ltx_tag'>", g, ".1</span>", e, "</h3>"))
        .when(F.col("j") == 4, put("<table class='ltx_equation' id='E", g, "'><tr class='ltx_eqn_row'><td><math display='block' alttext='a_{", g, "}'><mi>a</mi></math></td></tr><tr class='ltx_eqn_row'><td><math><annotation encoding='application/x-tex'>b</annotation></math><span class='ltx_tag ltx_tag_equation'>(", g, ")</span></td></tr></table>"))
        .when((F.col("j") == 5) & (kind == 3), put("<figure class='ltx_figure'><figure><img class='ltx_graphics' src='p1.png'></figure><figure><img class='ltx_graphics' src='p2.png'></figure><figcaption>Figure ", g, ": ", e, "</figcaption></figure>"))
        .when(F.col("j") == 5, put("<figure class='ltx_figure' id='F", g, "'><img class='ltx_graphics' src='", _number(), "v", F.when((kind == 5) & (F.col("i") > 10), "3").otherwise("2"), "/x", g, ".png'><figcaption><span class='ltx_tag ltx_tag_figure'>Figure ", g, ": </span>", e, "</figcaption></figure>"))
        .when(F.col("j") == 6, put("<figure class='ltx_table'><figcaption class='ltx_caption'>Table ", g, ": ", e, "</figcaption><table class='ltx_tabular'><tr><td>Name</td><td>Score</td></tr><tr><td>ours<td><math alttext='", g, ".5'></math></td></tr></table></figure>"))
        .when(F.col("j") == 7, put("<div class='ltx_para'><p>", e, " <strong class='x'>so</strong> <em>it</em> <span>is</span> <math alttext='x&lt;1'></math><span class='ltx_note'>note</span><script>s()</script></p></div>"))
        .when(F.col("j") == 8, put("<h6 class='ltx_title ltx_title_paragraph'>", e, "</h6>"))
        .otherwise(put("<p id='p", F.col("i").cast("string"), "'>", e, F.when((kind == 2) & (F.col("i") == 1), "<svg></svg>").otherwise(""), "</p>"))
    )
    body = n.select("doc_id", "i", html.alias("html")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "html"))), lambda x: x["html"]), "\n").alias("body"))
    start = F.when(kind == 1, "<article>").otherwise("<article class='ltx_document ltx_authors_1line'>")
    return body.select("doc_id", put("<html><body>", start, "<h1 class='ltx_title ltx_title_document'>Paper &amp; title</h1><div class='ltx_authors'><span>A. One</span> <span>B. Two</span></div>", F.col("body"), "</article></body></html>").alias("html"))


@query(
    "article_blocks",
    f"""WITH {_WRITTEN}, r AS (
      SELECT doc_id, i - 1 AS ord, CASE j WHEN 2 THEN 'sec' WHEN 3 THEN 'sub' WHEN 4 THEN 'eq' WHEN 5 THEN 'fig' WHEN 6 THEN 'tab' ELSE 'p' END AS type,
        CASE j WHEN 2 THEN CAST(g AS VARCHAR) WHEN 3 THEN g || '.1' WHEN 4 THEN '(' || g || ')' WHEN 5 THEN 'Figure ' || g WHEN 6 THEN 'Table ' || g END AS n,
        CASE WHEN j < 2 THEN CASE WHEN g = 1 THEN '' ELSE (g - 1) || '/' || (g - 1) || '.1' END WHEN j = 2 THEN CAST(g AS VARCHAR) ELSE g || '/' || g || '.1' END AS section,
        CASE WHEN j = 4 THEN 'a_{{' || g || '}} b' WHEN j IN (5, 6) THEN NULL WHEN j = 7 THEN e || ' <b>so</b> <i>it</i> is \\(x&lt;1\\)' WHEN j = 8 THEN '<b>' || e || '</b>' ELSE e END AS text,
        CASE WHEN j = 4 THEN '\\begin{{aligned}}a_{{' || g || '}}\\\\b\\end{{aligned}}' END AS latex,
        CASE WHEN j = 5 OR j = 6 THEN CASE WHEN j = 6 THEN 'Table ' ELSE 'Figure ' END || g || ': ' || e END AS caption,
        CASE WHEN j = 5 AND doc_id % 6 = 3 THEN 'html_structure' END AS fallback, CASE WHEN j = 5 AND doc_id % 6 = 3 THEN 2 END AS panels,
        CASE WHEN j = 4 THEN 'E' || g WHEN j = 5 AND doc_id % 6 <> 3 THEN 'F' || g WHEN j IN (0, 1, 9) THEN 'p' || i END AS anchor FROM k WHERE doc_id IN (SELECT doc_id FROM read))
    SELECT * FROM r UNION ALL SELECT doc_id, -1, 'meta', NULL, NULL, 'Paper &amp; title', NULL, 'A. One B. Two', NULL, NULL, NULL FROM read
    UNION ALL SELECT DISTINCT doc_id, -1, 'refused', NULL, NULL, NULL, NULL, NULL, NULL, NULL::INT, NULL FROM k WHERE doc_id NOT IN (SELECT doc_id FROM read)""",
)
def article_blocks(spark, sf_dir):
    """Blocks of articles: numbered headings, equations of two rows, figures of one and two panels, tables, text with markup and formulas, refusals."""
    rows = article.articles(_written(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "ord", "type", "n", F.array_join("section", "/").alias("section"), "text", "latex", "caption", "fallback", "panels", "anchor")


@query(
    "article_tables",
    f"""WITH {_WRITTEN} SELECT doc_id, i - 1 AS ord, head, 0 AS r, c AS k, CASE WHEN v = '' THEN g || '.5' ELSE v END AS text FROM k, (VALUES (true, 0, 'Name'), (true, 1, 'Score'), (false, 0, 'ours'), (false, 1, '')) AS v(head, c, v) WHERE j = 6 AND doc_id IN (SELECT doc_id FROM read)""",
)
def article_tables(spark, sf_dir):
    """The cells of the articles' tables, whose heads are rows of plain cells above figures."""
    rows = article.articles(_written(spark, sf_dir), "doc_id").filter("table IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ord").cast("bigint").alias("ord"), F.col("table").alias("html"))
    return tables.html_cells(rows, ["doc_id", "ord"], "html", heads=True).select("doc_id", "ord", "head", "r", "k", "text")


_ID = "printf('9901.%05d', doc_id)"


@query(
    "paper_imports",
    f"""WITH {_WRITTEN}, d AS (SELECT doc_id, max(i) AS n, max(i) FILTER (j = 5) AS f FROM k GROUP BY doc_id),
    p AS (SELECT *, {_ID} || CASE WHEN doc_id % 4 = 0 THEN 'v2' WHEN doc_id % 4 = 3 THEN 'v1' ELSE '' END AS paper, doc_id % 11 = 0 AS none, doc_id % 6 IN (1, 2) AS refused, doc_id % 6 = 3 AND f IS NOT NULL AS panels FROM d),
    v AS (SELECT *, CASE WHEN f IS NULL OR doc_id % 6 = 3 THEN 0 WHEN doc_id % 6 = 5 AND f > 10 THEN 2 ELSE 1 END AS versions FROM p),
    q AS (SELECT *, CASE WHEN none THEN 'html_unavailable' WHEN refused THEN 'html_structure'
        WHEN (doc_id % 4 = 0 AND versions = 2) OR (doc_id % 4 = 3 AND versions > 0) OR (doc_id % 4 IN (1, 2) AND versions > 1) THEN 'html_images'
        WHEN panels AND (doc_id % 7 = 0 OR doc_id % 4 IN (1, 2)) THEN 'html_structure' END AS reason FROM v)
    SELECT paper, CASE WHEN NOT none AND NOT refused AND doc_id % 4 IN (1, 2) AND versions = 1 THEN {_ID} || 'v2' ELSE paper END AS source, CASE WHEN reason IS NOT NULL THEN 'pdf' WHEN panels THEN 'mixed' ELSE 'html' END AS kind, reason FROM q""",
)
def paper_imports(spark, sf_dir):
    """Where the blocks of each paper come from: its HTML, its HTML with pictures of the PDF, or the PDF, and why."""
    number = _number()
    version = F.when(F.col("doc_id") % 4 == 0, "v2").when(F.col("doc_id") % 4 == 3, "v1").otherwise("")
    papers = _written(spark, sf_dir).select("doc_id", F.concat(number, version).alias("paper"), F.when(F.col("doc_id") % 11 != 0, F.col("html")).alias("html"))
    found = article.articles(papers.filter("html IS NOT NULL"), "paper")
    # placeholders are found in every PDF but each seventh
    resolved = found.filter("fallback IS NOT NULL").join(papers.select("paper", "doc_id"), "paper").filter("doc_id % 7 <> 0")
    return article.imported(papers.select("paper", "html"), found, resolved, _BASE)
