"""Context of blocks: references, evidence, headings, notes, sorts, and rules on lists of references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.operators import context as O
from folium.operators import relations
from folium.operators.sequence import section_paths
from folium.sources.tables import blocks, table

from .queries_filters import RICH, rich_blocks
from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

#: Every seventh block names a table and a figure; visuals are numbered by kind.
_NAMED = f"""{RICH}, vis AS (SELECT doc_id, ord, id, type AS kind, CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS VARCHAR) AS n FROM rich WHERE type IN ('tab', 'fig', 'eq')),
named AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 2 THEN text || ' see Table ' || (ord % 5) || ' and Figure ' || (ord % 3) || ', Eq. (1) or Eq. 2' ELSE text END AS text FROM rich),
mention AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '\\b(Table|Fig|Eq)[a-z]*\\.?[ \\t\\n\\r\\f\\v]*([0-9]+)', 1)) AS k, CAST(unnest(regexp_extract_all(text, '\\b(Table|Fig|Eq)[a-z]*\\.?[ \\t\\n\\r\\f\\v]*([0-9]+)', 2)) AS BIGINT) AS num FROM named)"""


def _visuals(r):
    n = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("ord")).cast("string")
    return r.filter("type in ('tab', 'fig', 'eq')").select("doc_id", "ord", "id", F.col("type").alias("kind"), n.alias("n"))


def _named(r):
    extra = F.format_string(" see Table %d and Figure %d, Eq. (1) or Eq. 2", F.col("ord") % 5, F.col("ord") % 3)
    return r.select("doc_id", "ord", F.when(F.col("ord") % 7 == 2, F.concat("text", extra)).otherwise(F.col("text")).alias("text"))


@query("cross_references", f"WITH {_NAMED} SELECT DISTINCT m.doc_id, m.ord, (SELECT 1) * 0 + v.o AS target_ord FROM (SELECT doc_id, ord, CASE k WHEN 'Table' THEN 'tab' WHEN 'Fig' THEN 'fig' ELSE 'eq' END AS kind, num FROM mention) m JOIN (SELECT doc_id, kind, CAST(n AS BIGINT) AS num, min(ord) AS o FROM vis GROUP BY ALL) v USING (doc_id, kind, num)".replace("(SELECT 1) * 0 + ", ""))
def cross_references(spark, sf_dir):
    """Visuals that blocks name, as the first of their kind with that number."""
    r = rich_blocks(spark, sf_dir)
    found = O.cross_references(_named(r), _visuals(r))
    return found.select("doc_id", "ord", F.substring("target", 2, 100).cast("bigint").alias("target_ord"))


@query("label_evidence", f"WITH {_NAMED}, w AS (SELECT DISTINCT doc_id, ord // 20 AS batch, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+')) AS n FROM named), e AS (SELECT w.doc_id, batch, v.id, row_number() OVER (PARTITION BY w.doc_id, batch ORDER BY v.ord) AS k FROM w JOIN vis v ON v.doc_id = w.doc_id AND v.n = w.n AND v.kind = 'tab') SELECT doc_id, batch, id FROM e WHERE k <= 8")
def label_evidence(spark, sf_dir):
    """Tables whose number stands in the text of a batch of twenty blocks."""
    r = rich_blocks(spark, sf_dir)
    b = _named(r).groupBy("doc_id", F.floor(F.col("ord") / 20).alias("batch")).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return O.label_evidence(b, _visuals(r).filter("kind = 'tab'"))


@query(
    "enclosing_headings",
    f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT doc_id, ord, id, ord % 3 AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM blocks WHERE type = 'sec'),
    p AS (SELECT doc_id, id, k, [id] AS path FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.id, h.k, list_append(p.path[1:h.depth], h.id) FROM p JOIN h ON h.doc_id = p.doc_id AND h.k = p.k + 1)
    SELECT doc_id, id, heading FROM (SELECT doc_id, id, unnest(path) AS heading FROM p) WHERE heading <> id""",
)
def enclosing_headings(spark, sf_dir):
    """Headings above each heading, by paths that begin its own."""
    b = blocks(table(spark, sf_dir, "documents")).filter("type = 'sec'")
    told = section_paths(b, "doc_id", "ord", (F.col("ord") % 3).cast("int"), F.col("id")).select("doc_id", "id", "path")
    return O.enclosing_headings(told, told)


@query(
    "multiword_terms",
    """WITH t AS (SELECT DISTINCT lower(w[1] || ' ' || w[2]) AS term FROM (SELECT regexp_extract_all(text, '[\\p{L}\\p{Nd}]+') AS w FROM benchmark) WHERE len(w) > 1),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord FROM documents),
    g AS (SELECT doc_id, ord, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM l), p AS (SELECT DISTINCT doc_id, ord, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM g)
    SELECT doc_id, term, min(ord) AS first, count(*) AS n FROM p JOIN t USING (term) GROUP BY ALL""",
)
def multiword_terms(spark, sf_dir):
    """Where terms of two words (the first of each benchmark item) occur as whole words."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    terms = table(spark, sf_dir, "benchmark").select(w.alias("w")).filter("size(w) > 1").select(F.array_join(F.slice("w", 1, 2), " ").alias("term")).distinct()
    return O.multiword_hits(blocks(table(spark, sf_dir, "documents")), terms, 2)


@query("page_insertion", f"WITH {BLOCKS}, u AS (SELECT doc_id, max(ord // 8) OVER (PARTITION BY doc_id ORDER BY ord) AS page, 0 AS late, ord AS o, id FROM blocks UNION ALL SELECT doc_id, ord // 8, 1, 0, 'n-' || id FROM blocks WHERE ord % 10 = 3) SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY page, late, o, id) - 1 AS position FROM u")
def page_insertion(spark, sf_dir):
    """Rows found later go to the end of their page."""
    b = blocks(table(spark, sf_dir, "documents")).withColumn("page", F.floor(F.col("ord") / 8))
    added = b.filter("ord % 10 = 3").select("doc_id", F.concat(F.lit("n-"), "id").alias("id"), "page")
    return O.inserted_by_page(b, added)


_RECTS = "SELECT l_orderkey AS page, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS k, l_quantity AS y0, l_quantity + 5 AS y1, l_suppkey % 3 AS kind FROM lineitem"


@query("barriers", f"SELECT page, k, y0, max(CASE WHEN kind = 0 THEN y1 END) OVER (PARTITION BY page ORDER BY y0, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, min(CASE WHEN kind = 1 THEN y0 END) OVER (PARTITION BY page ORDER BY y0, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM ({_RECTS})")
def barriers(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 5).alias("y1"), (F.col("l_suppkey") % 3).alias("kind"))
    return O.barriers(r, F.col("kind") == 0, F.col("kind") == 1).select("page", "k", "y0", "above", "below")


@query(
    "kept_references",
    """WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS refs FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(list_filter(refs, lambda r: r % 3 > 0)[1:16], ',') AS kept, CAST(len(refs) AS BIGINT) AS n FROM o""",
)
def kept_references(spark, sf_dir):
    """References of a claim, each once and in order, of those that are evidence, sixteen at most."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("refs"))
    twice, known = F.concat("refs", "refs"), F.filter("refs", lambda r: r % 3 > 0)
    return o.select("o_custkey", F.array_join(O.kept_refs(twice, known, 16).cast("array<string>"), ",").alias("kept"), F.size("refs").cast("bigint").alias("n"))


@query("list_checks", "SELECT o_custkey, count(*) % 2 = 0 AS same, bool_and(o_orderkey % 4 < 3) AS inside, CAST(count(*) FILTER (o_orderkey % 4 = 3) AS BIGINT) AS outside FROM orders GROUP BY o_custkey")
def list_checks(spark, sf_dir):
    """Whether a new order has the notes of the old one, whether a selection can be selected, and what it has besides."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("old"))
    new = F.reverse(F.when(F.size("old") % 2 == 0, F.col("old")).otherwise(F.slice("old", 2, F.size("old"))))
    selectable = F.filter("old", lambda x: x % 4 < 3)
    besides = F.array_except("old", selectable)
    return o.select("o_custkey", (F.array_sort("old") == F.array_sort(new)).alias("same"), (F.size(besides) == 0).alias("inside"), F.size(besides).cast("bigint").alias("outside"))


@query("saved_notes", "SELECT doc_id, id, origin FROM (SELECT doc_id, 'n1' AS id, 'user' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'n2', 'model' FROM labels) UNION ALL SELECT doc_id, 'n1', 'model' FROM labels WHERE quality = 0")
def saved_notes(spark, sf_dir):
    """A section annotated again: notes of users stay, the rest is as the new answer has it."""
    labels = table(spark, sf_dir, "labels")
    note = lambda df, i, origin: df.select(F.col("doc_id").alias("anchor"), F.lit(i).alias("id"), origin.alias("origin"))
    old = note(labels, "n1", F.when(F.col("quality") == 1, "user").otherwise("model")).unionByName(note(labels, "n3", F.lit("model")))
    new = note(labels, "n1", F.lit("model")).unionByName(note(labels, "n2", F.lit("model")))
    return O.saved_notes(old, new).withColumnRenamed("anchor", "doc_id")


@query("library_sorts", "SELECT doc_id, title, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS place FROM (SELECT doc_id, source, lower(lang) || (doc_id % 120) || ' v' || (doc_id % 7) AS title, lower(lang) || lpad(CAST(doc_id % 120 AS VARCHAR), 12, '0') || ' v' || lpad(CAST(doc_id % 7 AS VARCHAR), 12, '0') AS k FROM documents WHERE lang IS NOT NULL)")
def library_sorts(spark, sf_dir):
    """Titles in natural order: numbers by value."""
    title = F.concat(F.lower("lang"), (F.col("doc_id") % 120).cast("string"), F.lit(" v"), (F.col("doc_id") % 7).cast("string"))
    d = table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "source", title.alias("title"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(O.natural_key(F.col("title")), "doc_id")).cast("bigint")
    return d.select("doc_id", "title", place.alias("place"))


@query("thread_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def thread_order(spark, sf_dir):
    """Newest first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place"))


@query("note_references", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, unnest([o_orderkey, o_orderkey + 1, -1]) AS ref FROM orders) r JOIN (SELECT o_orderkey FROM orders) k ON k.o_orderkey = r.ref GROUP BY o_custkey")
def note_references(spark, sf_dir):
    """References of notes that lead to a label; unknown ones are dropped."""
    o = table(spark, sf_dir, "orders")
    refs = o.select("o_custkey", F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1, F.lit(-1).cast("bigint"))).alias("ref"))
    return relations.known_references(refs, o.select(F.col("o_orderkey").alias("ref")), "o_custkey")


@query("other_versions", "SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderpriority <> top) AS others FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS top FROM orders) GROUP BY o_custkey")
def other_versions(spark, sf_dir):
    """Versions that assets name besides a document's own."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("vs"), F.max("o_orderpriority").alias("own"))
    return g.select("o_custkey", F.size(F.array_except("vs", F.array("own"))).cast("bigint").alias("others"))


@query(
    "captioned_artwork",
    f"""WITH {RICH}, it AS (SELECT doc_id, ord % 2 AS col, ord, CASE WHEN type IN ('fig', 'tab') THEN 'art' WHEN type = 'sec' THEN 'bar' WHEN type = 'p' AND ord % 3 = 1 THEN 'fig' WHEN type = 'p' AND ord % 3 = 2 THEN 'tab' END AS k FROM rich),
    c AS (SELECT doc_id, col, ord, k, CASE WHEN k = 'fig' THEN (SELECT max(m.ord) FROM it m WHERE m.doc_id = c.doc_id AND m.col = c.col AND m.k IN ('art', 'bar') AND m.ord < c.ord) ELSE (SELECT min(m.ord) FROM it m WHERE m.doc_id = c.doc_id AND m.col = c.col AND m.k IN ('art', 'bar') AND m.ord > c.ord) END AS near FROM it c WHERE k IN ('fig', 'tab'))
    SELECT c.doc_id, c.ord AS id, c.near AS art, abs(c.ord - c.near) * 20 - 15 AS gap FROM c JOIN it a ON a.doc_id = c.doc_id AND a.ord = c.near AND a.k = 'art' QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.near ORDER BY gap, c.ord) = 1""",
)
def captioned_artwork(spark, sf_dir):
    """Captions and their artwork, in documents of two columns; headings part them."""
    ord_, kind = F.col("ord"), F.col("type")
    items = rich_blocks(spark, sf_dir).select("doc_id", (ord_ % 2).alias("col"), ord_.alias("id"), (ord_ * 20).alias("y0"), (ord_ * 20 + 15).alias("y1"), kind)
    caption = F.when((kind == "p") & (F.col("id") % 3 == 1), "fig").when((kind == "p") & (F.col("id") % 3 == 2), "tab")
    return O.captioned(items, ["doc_id", "col"], caption, kind.isin("fig", "tab"), kind == "sec").select("doc_id", "id", "art", "gap")
