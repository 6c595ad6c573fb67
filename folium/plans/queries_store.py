"""Library listings, positions, usage and existence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.operators.relations import latest
from folium.sources.tables import blocks, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()


@query(
    "library_read_percent",
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, count(*) AS total FROM blocks GROUP BY doc_id)
    SELECT d.doc_id, t.total AS block_count, 'b' || lpad(CAST(d.doc_id % t.total AS VARCHAR), 4, '0') AS last_block,
      CAST(round(100.0 * (d.doc_id % t.total + 1) / t.total) AS BIGINT) AS read_percent, d.source LIKE '%1' AS has_thumbnail
    FROM documents d JOIN t USING (doc_id)""",
)
def library_read_percent(spark, sf_dir):
    """Documents with their last position: a rank in the order of blocks, not the order's value."""
    docs = table(spark, sf_dir, "documents")
    b = blocks(docs).select("doc_id", "ord", "id")
    total = b.groupBy("doc_id").agg(F.count("*").alias("block_count"))
    ranked = b.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    at = docs.select("doc_id", F.col("source").endswith("1").alias("has_thumbnail")).join(total, "doc_id").withColumn("ord", F.col("doc_id") % F.col("block_count"))
    out = at.join(ranked, ["doc_id", "ord"], "left")
    percent = F.coalesce(F.round(100.0 * F.col("rank") / F.nullif("block_count", F.lit(0))), F.lit(0)).cast("bigint")
    return out.select("doc_id", "block_count", F.col("id").alias("last_block"), percent.alias("read_percent"), "has_thumbnail")


@query("library_page", "SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 14 OFFSET 14")
def library_page(spark, sf_dir):
    """The second page of the shelf: a top-k, not a full sort."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").orderBy(F.desc("n_chars"), "doc_id").offset(14).limit(14)


@query("latest_event_per_user", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark, sf_dir):
    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", "ts", "event_id")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("usage_rollup", f"SELECT event_type AS stage, {_K} % 10 AS model, count(*) AS calls, CAST(round(sum(value), 4) AS DOUBLE) AS tokens, CAST(round(max(value), 4) AS DOUBLE) AS largest FROM events GROUP BY ALL")
def usage_rollup(spark, sf_dir):
    """Calls and tokens by stage and model."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("model"), "value")
    return e.groupBy("stage", "model").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.max("value"), 4).alias("largest"))


@query("usage_total", f"SELECT count(*) AS calls, count(DISTINCT user_id) AS users, CAST(round(sum(value), 3) AS DOUBLE) AS tokens, CAST(sum(CASE WHEN {_K} > 50 THEN 1 ELSE 0 END) AS BIGINT) AS retries FROM events")
def usage_total(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("tokens"), F.count_if(F.get_json_object("props", "$.k").cast("bigint") > 50).alias("retries"))


@query("thread_message_count", "SELECT conv_id, count(*) AS messages, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS questions, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def thread_message_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("unlabeled_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("labeled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labeled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("title_search", "SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title FROM documents WHERE contains(lower(trim(split_part(text, chr(10), 1))), 'thing')")
def title_search(spark, sf_dir):
    title = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title")).filter(F.lower("title").contains("thing"))


@query("estimates", "SELECT source, CAST(sum(n_chars) // 1 AS BIGINT) AS chars, CAST(floor(sum(n_chars) / 3 * 3) AS BIGINT) AS tokens_in, CAST(floor(sum(n_chars) / 3 * 1.4) AS BIGINT) AS tokens_out FROM documents GROUP BY source")
def estimates(spark, sf_dir):
    """Tokens that a job over each source would take and give."""
    n = F.sum("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("chars"), F.floor(n / 3 * 3).alias("tokens_in"), F.floor(n / 3 * 1.4).alias("tokens_out"))


@query("completion", "SELECT d.source, count(*) AS total, count(l.doc_id) AS complete, CAST(round(0.5 + 0.28 * count(l.doc_id) / count(*), 6) AS DOUBLE) AS progress, CASE WHEN count(l.doc_id) = count(*) THEN 'complete' ELSE 'ready_to_translate' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def completion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("done")), "doc_id", "left")
    g = d.groupBy("source").agg(F.count("*").alias("total"), F.count("done").alias("complete"))
    return g.select("source", "total", "complete", F.round(0.5 + 0.28 * F.col("complete") / F.col("total"), 6).alias("progress"), F.when(F.col("complete") == F.col("total"), "complete").otherwise("ready_to_translate").alias("status"))


@query("order_revenue", "SELECT n_name, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def order_revenue(spark, sf_dir):
    """A chain of equi joins and a rollup over the fact table."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_order = li.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    j = per_order.join(o, per_order["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("tumbling_usage", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY ALL")
def tumbling_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
