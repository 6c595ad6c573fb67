"""Queries over the blocks of documents: ids, numbers, packing, headings, terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import sequence as S
from folium.operators.relations import term_hits, words_of
from folium.sources.tables import blocks, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()


def _blocks(spark, sf_dir):
    return blocks(table(spark, sf_dir, "documents"))


@query("block_explode", f"WITH {BLOCKS} SELECT doc_id, ord, id, type, CAST(length(text) AS BIGINT) AS chars FROM blocks")
def block_explode(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "ord", "id", "type", F.length("text").cast("bigint").alias("chars"))


@query("block_type_counts", f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, CAST(sum((type IN ('p', 'li'))::INT) AS BIGINT) AS paragraphs, CAST(sum((type = 'sec')::INT) AS BIGINT) AS headings FROM blocks GROUP BY doc_id")
def block_type_counts(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type").isin("p", "li")).alias("paragraphs"), F.count_if(F.col("type") == "sec").alias("headings"))


@query("stable_block_id", f"WITH {BLOCKS} SELECT doc_id, ord, substring(sha256(CAST(doc_id AS VARCHAR) || '|' || id || '|' || text), 1, 20) AS key FROM blocks")
def stable_block_id(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "ord", T.stable_id(F.col("doc_id"), F.col("id"), F.col("text")).alias("key"))


@query(
    "number_tokens",
    r"""SELECT doc_id, CAST(len(n) AS BIGINT) AS numbers, array_to_string(n, ' ') AS tokens FROM (
      SELECT doc_id, regexp_extract_all(replace(text, '−', '-'), '(?:^|[^A-Za-z0-9_.])([-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?%?)', 1) AS n FROM documents) WHERE len(n) > 0""",
)
def number_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.col("text")).alias("n")).filter(F.size("n") > 0)
    return d.select("doc_id", F.size("n").cast("bigint").alias("numbers"), F.array_join("n", " ").alias("tokens"))


@query("token_estimate", r"SELECT doc_id, CAST(round((length(text) - w) / 3.6 + w / 1.3, 4) AS DOUBLE) AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[\x{0000}-\x{02FF}]', '', 'g')) AS w FROM documents)")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("document_search", f"WITH {BLOCKS} SELECT doc_id, ord, id FROM blocks WHERE contains(lower(text), 'with the')")
def document_search(spark, sf_dir):
    return _blocks(spark, sf_dir).filter(F.lower("text").contains("with the")).select("doc_id", "ord", "id")


@query("compact_text", f"WITH {BLOCKS} SELECT doc_id, ord, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, 1, 60), ' [^ ]*$', '') || ' …' END AS short FROM blocks")
def compact_text(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "ord", T.compact(F.col("text"), 60).alias("short"))


def _fold_sql(group: str, budget: int, most: int) -> str:
    return f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT doc_id, ord, length(text) AS s, {group} AS g FROM blocks),
    f AS (SELECT doc_id, ord, s, g, s AS len, 1 AS n, 0 AS batch FROM s WHERE ord = 0
      UNION ALL SELECT s.doc_id, s.ord, s.s, s.g, CASE WHEN c.x THEN s.s ELSE f.len + s.s END, CASE WHEN c.x THEN 1 ELSE f.n + 1 END, f.batch + CASE WHEN c.x THEN 1 ELSE 0 END
      FROM f JOIN s ON s.doc_id = f.doc_id AND s.ord = f.ord + 1, LATERAL (SELECT f.len + s.s > {budget} OR f.n >= {most} OR f.g IS DISTINCT FROM s.g AS x) c)
    SELECT doc_id, CAST(batch AS BIGINT) AS batch, min(ord) AS first, max(ord) AS last, count(*) AS n, CAST(sum(s) AS BIGINT) AS size FROM f GROUP BY doc_id, batch"""


@query("translate_packing", _fold_sql("'0'", 1200, 40))
def translate_packing(spark, sf_dir):
    return S.pack(_blocks(spark, sf_dir), "doc_id", "ord", F.length("text"), 1200, 40)


@query("section_packing", _fold_sql("ord // 12", 2000, 60))
def section_packing(spark, sf_dir):
    """Batches that do not cross sections (of twelve blocks)."""
    return S.pack(_blocks(spark, sf_dir), "doc_id", "ord", F.length("text"), 2000, 60, F.floor(F.col("ord") / 12))


@query(
    "request_chunks",
    """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o, turn, strlen(text) + 200 AS s FROM conversations),
    f AS (SELECT conv_id, o, turn, s, s AS len, 0 AS batch FROM s WHERE o = 0 UNION ALL
      SELECT s.conv_id, s.o, s.turn, s.s, CASE WHEN f.len + s.s > 2500 THEN s.s ELSE f.len + s.s END, f.batch + CASE WHEN f.len + s.s > 2500 THEN 1 ELSE 0 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.o = f.o + 1)
    SELECT conv_id, CAST(batch AS BIGINT) AS batch, min(turn) AS first, max(turn) AS last, count(*) AS n, CAST(sum(s) AS BIGINT) AS size FROM f GROUP BY conv_id, batch""",
)
def request_chunks(spark, sf_dir):
    """Messages in requests of bounded bytes."""
    return S.pack(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.octet_length("text") + 200, 2500, 1 << 30)


@query(
    "neighbors",
    f"WITH {BLOCKS} SELECT b.doc_id, b.ord, coalesce(string_agg(n.id, ' ' ORDER BY n.ord), '') AS around FROM blocks b LEFT JOIN blocks n ON n.doc_id = b.doc_id AND n.ord BETWEEN b.ord - 2 AND b.ord + 2 AND n.ord <> b.ord GROUP BY b.doc_id, b.ord",
)
def neighbors(spark, sf_dir):
    return S.neighbours(_blocks(spark, sf_dir).select("doc_id", "ord", "id"), "doc_id", "ord", "id", 2).select("doc_id", "ord", F.array_join("around", " ").alias("around"))


@query("asof_heading", f"WITH {BLOCKS} SELECT doc_id, ord, last_value(CASE WHEN type = 'sec' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM blocks")
def asof_heading(spark, sf_dir):
    return S.as_of_heading(_blocks(spark, sf_dir), "doc_id", "ord", F.col("type") == "sec", F.col("text")).select("doc_id", "ord", "heading")


@query("section_label_on_change", f"WITH {BLOCKS} SELECT doc_id, ord, CASE WHEN type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc_id ORDER BY ord) THEN type END AS label FROM blocks")
def section_label_on_change(spark, sf_dir):
    return S.on_change(_blocks(spark, sf_dir), "doc_id", "ord", "type", "label").select("doc_id", "ord", "label")


@query("gap_cluster", "SELECT user_id, cluster, count(*) AS n, CAST(round(sum(x), 2) AS DOUBLE) AS total FROM (SELECT user_id, x, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM (SELECT user_id, event_id, value AS x, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 1.5 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL")
def gap_cluster(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"))
    return S.gap_clusters(e, "user_id", "x", 1.5, "event_id").groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query(
    "row_cluster",
    """WITH RECURSIVE v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
    f AS (SELECT user_id, x, i, x AS a FROM v WHERE i = 1 UNION ALL SELECT v.user_id, v.x, v.i, CASE WHEN v.x - f.a > 4 THEN v.x ELSE f.a END FROM f JOIN v ON v.user_id = f.user_id AND v.i = f.i + 1)
    SELECT user_id, a AS anchor, count(*) AS n FROM f GROUP BY user_id, a""",
)
def row_cluster(spark, sf_dir):
    return S.anchored_clusters(table(spark, sf_dir, "events"), "user_id", "value", 4.0)


@query("reordered_blocks", "SELECT o_custkey, o_orderkey, o_totalprice < max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) OR o_totalprice > min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS moved FROM orders")
def reordered_blocks(spark, sf_dir):
    """Rows of one owner whose old rank (price) and new rank (key) cross those of another."""
    return S.reordered(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "moved")


@query("conversation_history", "SELECT conv_id, turn, CAST(count(*) OVER w AS BIGINT) AS messages, CAST(sum(length(text)) OVER w AS BIGINT) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def conversation_history(spark, sf_dir):
    """What an answer at each turn has before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("messages"), F.sum(F.length("text")).over(w).cast("bigint").alias("chars"))


@query("regenerate_context", "SELECT conv_id, count(*) AS messages, max(turn) AS last FROM conversations c WHERE turn < (SELECT max(turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user') GROUP BY conv_id")
def regenerate_context(spark, sf_dir):
    """Messages before the last question of each thread."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    q = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    return c.join(q, "conv_id").filter("turn < q").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last"))


@query("order_compaction", f"WITH {BLOCKS} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS position FROM blocks WHERE type <> 'sec'")
def order_compaction(spark, sf_dir):
    return S.compacted(_blocks(spark, sf_dir).filter("type <> 'sec'"), "doc_id", "ord").select("doc_id", "ord", "position")


@query(
    "section_path",
    f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT doc_id, ord, CASE WHEN type = 'sec' THEN ord % 3 END AS d, trim(text) AS l FROM blocks),
    f AS (SELECT doc_id, ord, CASE WHEN d IS NULL THEN CAST([] AS VARCHAR[]) ELSE [l] END AS path FROM h WHERE ord = 0
      UNION ALL SELECT h.doc_id, h.ord, CASE WHEN h.d IS NULL THEN f.path ELSE list_append(f.path[1:h.d], h.l) END FROM f JOIN h ON h.doc_id = f.doc_id AND h.ord = f.ord + 1)
    SELECT doc_id, ord, array_to_string(path, '/') AS path FROM f""",
)
def section_path(spark, sf_dir):
    """Headings of three depths and the path that each block stands under."""
    depth = F.when(F.col("type") == "sec", F.col("ord") % 3)
    return S.section_paths(_blocks(spark, sf_dir), "doc_id", "ord", depth, F.trim("text")).select("doc_id", "ord", F.array_join("path", "/").alias("path"))


_TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'), 1) - 1 AS pos FROM documents"


@query("vocabulary_counts", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_TOKENS}) GROUP BY term HAVING count(*) >= 2")
def vocabulary_counts(spark, sf_dir):
    w = words_of(table(spark, sf_dir, "documents"), "text", "doc_id")
    per = w.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.col("token").alias("term")).agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n >= 2")


@query("term_candidates", f"SELECT doc_id, term, n, first, rank FROM (SELECT doc_id, term, count(*) AS n, min(pos) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM ({_TOKENS}) WHERE length(term) > 2 GROUP BY doc_id, term HAVING count(*) >= 2) WHERE rank <= 20")
def term_candidates(spark, sf_dir):
    """The terms most used in each document; of equal ones, the first seen."""
    # whole texts are shuffled, which are smaller than their terms with counts, and all that follows is by document
    w = words_of(table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id"), "text", "doc_id").filter(F.length("token") > 2)
    g = w.groupBy("doc_id", F.col("token").alias("term")).agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first")).filter("n >= 2")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")).cast("bigint")).filter("rank <= 20")


@query(
    "bigram_terms",
    f"WITH t AS ({_TOKENS}), b AS (SELECT doc_id, pos, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS term, length(term) > 2 AND length(lead(term) OVER (PARTITION BY doc_id ORDER BY pos)) > 2 AS ok FROM t) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b WHERE ok GROUP BY term HAVING count(*) >= 5",
)
def bigram_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)).alias("w"))
    pairs = d.select("doc_id", F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when((F.length(a) > 2) & (F.length(b) > 2), F.concat(a, F.lit(" "), b)))).alias("term")).filter("term is not null")
    per = pairs.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("n >= 5")


@query(
    "first_occurrence",
    f"""WITH {BLOCKS}, g AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, ord, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM blocks)
    SELECT doc_id, term, min(ord) AS first, count(*) AS n FROM w JOIN g USING (term) GROUP BY doc_id, term""",
)
def first_occurrence(spark, sf_dir):
    """The first block of each document that holds a glossary term as a whole word."""
    terms = table(spark, sf_dir, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("term")).distinct()
    return term_hits(_blocks(spark, sf_dir), terms)


@query("glossary_dedup", "SELECT term, item_id FROM (SELECT lower(split_part(text, ' ', 1)) AS term, item_id, row_number() OVER (PARTITION BY lower(split_part(text, ' ', 1)) ORDER BY item_id) AS r FROM benchmark) WHERE r = 1")
def glossary_dedup(spark, sf_dir):
    """Of terms that differ in case only, the first."""
    return table(spark, sf_dir, "benchmark").groupBy(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("term")).agg(F.min("item_id").alias("item_id"))


@query("glossary_excerpt", f"WITH {BLOCKS} SELECT doc_id, ord FROM (SELECT doc_id, ord, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks WHERE type <> 'sec') WHERE before <= 600")
def glossary_excerpt(spark, sf_dir):
    """Blocks up to the one that passes the budget, that one included."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return _blocks(spark, sf_dir).filter("type <> 'sec'").withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter("before <= 600").select("doc_id", "ord")


@query("utf16_slice", "SELECT doc_id, substring(text, 3, 8) AS piece FROM documents WHERE length(text) >= 12")
def utf16_slice(spark, sf_dir):
    """Selections by UTF-16 units; the texts have no characters outside the first plane."""
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 12).select("doc_id", T.utf16_slice(F.col("text"), 2, 10).alias("piece"))
