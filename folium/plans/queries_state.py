"""Diagnostics, exports, digests, snapshots, trees, and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators.changes import allowed, supersede, table_html, with_answers
from folium.operators.linkage import link
from folium.operators.relations import cascade_delete, descendants, merged_states, upsert
from folium.sources.tables import blocks, settled, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

_RULES = f"""{BLOCKS}, issues AS (
  SELECT 'empty_block' AS kind, 'info' AS severity, doc_id FROM blocks WHERE trim(text) = ''
  UNION ALL SELECT 'long_block', 'attention', doc_id FROM blocks WHERE length(text) > 1500
  UNION ALL SELECT 'unlabelled', 'info', doc_id FROM documents ANTI JOIN labels USING (doc_id)
  UNION ALL SELECT 'low_quality', 'attention', doc_id FROM labels WHERE quality = 0
  UNION ALL SELECT 'symbols', 'attention', doc_id FROM documents WHERE contains(text, '###'))"""


def _issues(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    b = blocks(docs)
    rule = lambda df, kind, severity: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "doc_id")
    found = [
        rule(b.filter("trim(text) = ''"), "empty_block", "info"),
        rule(b.filter(F.length("text") > 1500), "long_block", "attention"),
        rule(docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti"), "unlabelled", "info"),
        rule(labels.filter("quality = 0"), "low_quality", "attention"),
        rule(docs.filter(F.col("text").contains("###")), "symbols", "attention"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("diagnostics_by_kind", f"WITH {_RULES} SELECT kind, severity, count(*) AS issues, count(DISTINCT doc_id) AS docs FROM issues GROUP BY ALL")
def diagnostics_by_kind(spark, sf_dir):
    """A frame for each rule, united and counted."""
    return _issues(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("issues"), F.countDistinct("doc_id").alias("docs"))


@query("attention_documents", f"WITH {_RULES} SELECT doc_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM issues WHERE severity = 'attention' GROUP BY doc_id")
def attention_documents(spark, sf_dir):
    return _issues(spark, sf_dir).filter("severity = 'attention'").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("markdown_export", f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, sha256(string_agg('<a id=\"' || id || '\"></a>' || chr(10) || CASE type WHEN 'sec' THEN '# ' WHEN 'li' THEN '- ' ELSE '' END || regexp_replace(text, '([\\\\`*_\\[\\]#|<>])', '\\\\\\1', 'g'), chr(10) || chr(10) ORDER BY ord)) AS sha FROM blocks GROUP BY doc_id")
def markdown_export(spark, sf_dir):
    """Each document as ordered Markdown; its hash and number of blocks."""
    lead = F.when(F.col("type") == "sec", "# ").when(F.col("type") == "li", "- ").otherwise("")
    part = F.concat(F.lit('<a id="'), F.col("id"), F.lit('"></a>\n'), lead, T.markdown_escape(F.col("text")))
    g = blocks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", part.alias("m")))).alias("ms"))
    return g.select("doc_id", F.size("ms").cast("bigint").alias("blocks"), F.sha2(F.array_join(F.transform("ms", lambda m: m["m"]), "\n\n"), 256).alias("sha"))


@query("section_digest", f"WITH {BLOCKS}, s AS (SELECT doc_id, ord // 10 AS section, sum(length(text)) AS chars, count(*) AS n, max(length(text)) AS longest FROM blocks GROUP BY ALL) SELECT doc_id, count(*) AS sections, CAST(max(chars) AS BIGINT) AS largest, CAST(sum(longest) AS BIGINT) AS digest_chars FROM s GROUP BY doc_id")
def section_digest(spark, sf_dir):
    """Two levels: sections, then the document."""
    s = blocks(table(spark, sf_dir, "documents")).groupBy("doc_id", F.floor(F.col("ord") / 10).alias("section")).agg(F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sections"), F.max("chars").cast("bigint").alias("largest"), F.sum("longest").cast("bigint").alias("digest_chars"))


@query("upsert_snapshot", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang, n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, 'xx', 0 FROM labels WHERE toxic = 1")
def upsert_snapshot(spark, sf_dir):
    """Changed rows replace theirs, new rows are added."""
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    changed = old.filter("doc_id % 3 = 0").withColumn("lang", F.upper("lang"))
    added = table(spark, sf_dir, "labels").filter("toxic = 1").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("xx").alias("lang"), F.lit(0).cast("bigint").alias("n_chars"))
    return upsert(old, changed.unionByName(added), ["doc_id"])


@query("cascade_delete", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 7 GROUP BY c_custkey")
def cascade(spark, sf_dir):
    """What is left of customers and orders when the customers of a nation go."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    gone = c.filter("c_nationkey = 7").select(F.col("c_custkey").alias("k"))
    left = cascade_delete(gone, "k", {"c": c.select(F.col("c_custkey").alias("k")), "o": o.select(F.col("o_custkey").alias("k"), "o_orderkey")})
    n = left["o"].groupBy("k").agg(F.count("*").alias("orders"))
    return left["c"].join(n, "k", "left").select(F.col("k").alias("c_custkey"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "job_state_merge",
    """WITH e AS (SELECT *, row_number() OVER w AS k, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS seen, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS bought FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT *, max(CASE WHEN event_type = 'error' THEN k END) OVER w AS paused, max(CASE WHEN event_type = 'click' THEN k END) OVER w AS queued FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, CASE WHEN paused > coalesce(queued, 0) THEN 'error' ELSE event_type END AS status, seen, bought FROM f""",
)
def job_state_merge(spark, sf_dir):
    """A paused job (error) stays so until it is queued (click); of each key of its checkpoint (seen, bought), the last value stays."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return merged_states(e, w, F.col("event_type") == "error", F.col("event_type") == "click", F.col("event_type"), {"seen": F.when(F.col("event_type") == "view", F.col("value")), "bought": F.when(F.col("event_type") == "purchase", F.col("value"))}).select("user_id", "event_id", F.when(F.col("held"), "error").otherwise(F.col("event_type")).alias("status"), "seen", "bought")


@query("family_closure", "WITH RECURSIVE t AS (SELECT doc_id AS root, doc_id AS node, 0 AS depth FROM documents WHERE doc_id BETWEEN 1 AND 3 UNION ALL SELECT t.root, d.doc_id, t.depth + 1 FROM t JOIN documents d ON d.doc_id // 4 = t.node AND d.doc_id > 3) SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS nodes FROM t GROUP BY root, depth")
def family_closure(spark, sf_dir):
    """All notes under the first ones, level by level."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    edges = docs.filter("doc_id > 3").select(F.floor(F.col("doc_id") / 4).alias("parent"), F.col("doc_id").alias("child"))
    roots = docs.filter("doc_id between 1 and 3").select(F.col("doc_id").alias("root"))
    return descendants(edges, roots).groupBy("root", F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("nodes"))


@query("note_tree_order", "WITH RECURSIVE t AS (SELECT doc_id, [doc_id] AS path FROM documents WHERE doc_id BETWEEN 1 AND 3 UNION ALL SELECT d.doc_id, list_append(t.path, d.doc_id) FROM t JOIN documents d ON d.doc_id // 4 = t.doc_id AND d.doc_id > 3) SELECT doc_id, array_to_string(path, '/') AS path FROM t")
def note_tree_order(spark, sf_dir):
    """Each note with its path; sorted by path, notes stand right after their anchors."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    now = docs.filter("doc_id between 1 and 3").select("doc_id", F.array("doc_id").alias("path"))
    edges = docs.filter("doc_id > 3").select(F.floor(F.col("doc_id") / 4).alias("parent"), "doc_id")
    out = now
    while not now.isEmpty():
        #: A note is not put under itself, so cycles end.
        below = now.select(F.col("doc_id").alias("parent"), "path").join(edges, "parent").filter(~F.array_contains("path", F.col("doc_id")))
        now = settled(below.select("doc_id", F.concat("path", F.array("doc_id")).alias("path")))
        out = out.unionByName(now)
    return out.select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("progress_changes", "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def progress_changes(spark, sf_dir):
    """Events that change the state of their key, as the progress stream emits them."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("b", before).filter(~F.col("event_type").eqNullSafe(F.col("b"))).select("user_id", "event_id", "event_type")


@query("redacted_messages", "SELECT conv_id, turn, replace(replace(text, 'the', '[REDACTED]'), 'der', '[REDACTED]') AS text FROM conversations")
def redacted_messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.redact(F.col("text"), ["the", "der"]).alias("text"))


@query("ask_context", f"WITH {BLOCKS}, q AS (SELECT doc_id, count(*) // 2 AS at FROM blocks GROUP BY doc_id) SELECT b.doc_id, q.at, string_agg(b.id, ' ' ORDER BY b.ord) AS context, CAST(sum(length(b.text)) AS BIGINT) AS chars FROM q JOIN blocks b ON b.doc_id = q.doc_id AND (b.ord BETWEEN q.at - 2 AND q.at + 2 OR b.type = 'sec' AND b.ord < q.at) GROUP BY b.doc_id, q.at")
def ask_context(spark, sf_dir):
    """For the middle block of each document: the blocks around it and the headings before it."""
    b = blocks(table(spark, sf_dir, "documents")).withColumn("at", F.floor(F.count("*").over(Window.partitionBy("doc_id")) / 2))
    near = b.filter(F.col("ord").between(F.col("at") - 2, F.col("at") + 2) | ((F.col("type") == "sec") & (F.col("ord") < F.col("at"))))
    g = near.groupBy("doc_id", "at").agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("s"), F.sum(F.length("text")).cast("bigint").alias("chars"))
    return g.select("doc_id", "at", F.array_join(F.transform("s", lambda x: x["id"]), " ").alias("context"), "chars")


@query(
    "supersede_apply",
    f"""WITH {BLOCKS}, b AS (SELECT *, CASE WHEN ord % 5 = 0 AND ord % 10 <> 0 THEN 'r-' || id END AS nid FROM blocks),
    u AS (SELECT doc_id, ord, 0 AS late, id, text, nid AS superseded_by FROM b UNION ALL SELECT doc_id, ord, 1, nid, text || '!', NULL FROM b WHERE nid IS NOT NULL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, late) - 1 AS position, id, text, superseded_by FROM u""",
)
def supersede_apply(spark, sf_dir):
    """Every fifth block of a new extraction: half of them are as before, the others have changed."""
    b = blocks(table(spark, sf_dir, "documents"))
    changed = b.filter("ord % 5 = 0").select("doc_id", "id", F.when(F.col("ord") % 10 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"))
    return supersede(b.select("doc_id", "ord", "id", "text"), changed)


@query(
    "batch_results",
    "SELECT q.conv_id, q.turn, a.text AS answer, CASE WHEN a.turn % 3 = 0 THEN 'late' END AS error, CASE WHEN a.turn % 3 = 0 THEN 'failed' WHEN a.text IS NOT NULL THEN 'answered' ELSE 'retry' END AS status FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'",
)
def batch_results(spark, sf_dir):
    """Questions with the answers that came back; those without are asked again."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn")
    came = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, "late").alias("error"))
    return with_answers(asked, came, ["conv_id", "turn"]).select("conv_id", "turn", "answer", "error", "status")


@query(
    "status_gates",
    "SELECT old, new, count(*) AS n, (old = 'view' AND new IN ('click', 'purchase')) OR (old = 'click' AND new IN ('purchase', 'error')) AS allowed FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events) WHERE old IS NOT NULL GROUP BY old, new",
)
def status_gates(spark, sf_dir):
    """Steps between states, and whether the transition table has them."""
    e = table(spark, sf_dir, "events").select(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("old"), F.col("event_type").alias("new"))
    g = e.filter("old is not null").groupBy("old", "new").agg(F.count("*").alias("n"))
    return g.withColumn("allowed", allowed(F.col("old"), F.col("new"), {"view": ["click", "purchase"], "click": ["purchase", "error"]}))


@query(
    "table_html",
    "SELECT o_custkey, '<table>' || string_agg('<tr><td>' || o_orderkey || '</td><td>' || replace(o_orderpriority, '>', '&gt;') || '</td></tr>', '' ORDER BY o_orderkey) || '</table>' AS html FROM orders GROUP BY o_custkey",
)
def orders_html(spark, sf_dir):
    """Each customer's orders as a table."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("o_orderkey").cast("string").alias("text")), F.struct(F.lit(1).alias("c"), F.col("o_orderpriority").alias("text")))).alias("x"))
    return table_html(o.select("o_custkey", "o_orderkey", "x.*"), "o_custkey", "o_orderkey", "c", F.col("text"), F.lit(False))


@query("block_links")
def block_links(spark, sf_dir):
    """Each document's blocks linked with a later extraction in which every seventh is missing, every ninth moved a page and every fifth is edited."""
    b = blocks(table(spark, sf_dir, "documents"))
    page = (F.floor(F.col("ord") / 12) + 1).cast("int")
    top = (F.col("ord") % 12) * 60.0
    rect = {"x0": F.lit(0.0).alias("x0"), "y0": top.alias("y0"), "x1": F.lit(200.0).alias("x1"), "y1": (top + 30).alias("y1")}
    cols = lambda at: [F.col("ord").alias("id"), "ord", "type", F.lit("1").alias("section"), at.alias("page"), F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("anchor"), "text", F.sha2("text", 256).alias("sig"), *rect.values()]
    edited = F.when(F.col("ord") % 5 == 3, F.overlay("text", F.lit("#"), 6)).otherwise(F.col("text"))
    new = b.filter("(ord + doc_id) % 7 <> 0").withColumn("text", edited)
    return link(b.select("doc_id", *cols(page)), new.select("doc_id", *cols(page + (F.col("ord") % 9 == 0).cast("int"))))
