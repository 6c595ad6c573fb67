"""Filters of the stages, over blocks with sections, versions and sources that are derived from the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.operators import filters as O
from folium.sources.tables import blocks, table

from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

#: Blocks with more types, every fourth section being references, some rows superseded or without source.
RICH = f"""{BLOCKS}, rich AS (SELECT doc_id, ord, id, ord % 23 = 7 AS superseded, ord % 11 <> 4 AS sourced,
  CASE WHEN type = 'sec' THEN 'sec' WHEN ord % 17 = 3 THEN 'tab' WHEN ord % 17 = 9 THEN 'fig' WHEN ord % 17 = 13 THEN 'eq' WHEN ord % 19 = 5 THEN 'card' ELSE type END AS type,
  CASE WHEN type = 'sec' AND (doc_id + ord) % 4 = 0 THEN 'References' ELSE text END AS text FROM blocks),
secs AS (SELECT *, last_value(CASE WHEN type = 'sec' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM rich),
marked AS (SELECT *, coalesce(lower(trim(section)) IN ('references', 'bibliography'), false) AS ref FROM secs)"""
_LIVE = "type <> 'card' AND NOT superseded"


def rich_blocks(spark, sf_dir):
    b, ord_ = blocks(table(spark, sf_dir, "documents")), F.col("ord")
    kind = F.when(F.col("type") == "sec", "sec").when(ord_ % 17 == 3, "tab").when(ord_ % 17 == 9, "fig").when(ord_ % 17 == 13, "eq").when(ord_ % 19 == 5, "card").otherwise(F.col("type"))
    text = F.when((F.col("type") == "sec") & ((F.col("doc_id") + ord_) % 4 == 0), "References").otherwise(F.col("text"))
    r = b.select("doc_id", "ord", "id", (ord_ % 23 == 7).alias("superseded"), (ord_ % 11 != 4).alias("sourced"), kind.alias("type"), text.alias("text"))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.withColumn("section", F.last(F.when(F.col("type") == "sec", F.col("text")), ignorenulls=True).over(w))


@query("translation_targets", f"WITH {RICH} SELECT doc_id, id, type FROM marked WHERE {_LIVE} AND NOT ref AND type IN ('sec', 'sub', 'ssub', 'p', 'li', 'tab', 'fig')")
def translation_targets(spark, sf_dir):
    return O.translation_targets(rich_blocks(spark, sf_dir)).select("doc_id", "id", "type")


@query("evidence_blocks", f"WITH {RICH} SELECT doc_id, id FROM marked WHERE {_LIVE} AND sourced AND NOT ref")
def evidence_blocks(spark, sf_dir):
    return O.evidence(rich_blocks(spark, sf_dir)).select("doc_id", "id")


@query("annotatable_blocks", f"WITH {RICH} SELECT doc_id, id FROM marked WHERE {_LIVE} AND sourced AND NOT ref")
def annotatable_blocks(spark, sf_dir):
    return O.annotatable(rich_blocks(spark, sf_dir)).select("doc_id", "id")


@query("active_versions", f"WITH {RICH} SELECT doc_id, count(*) AS n, CAST(sum(superseded::INT) AS BIGINT) AS asked FROM marked WHERE NOT superseded OR ord = 30 GROUP BY doc_id")
def active_versions(spark, sf_dir):
    """Current versions, and one row that is asked about although it has been superseded."""
    rows = O.active(rich_blocks(spark, sf_dir), F.col("ord") == 30)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("superseded").alias("asked"))


@query("visible_notes", f"WITH {RICH}, n AS (SELECT doc_id, id, ['key', 'trm', 'ctx', 'qst'][1 + ord % 4] AS kind FROM rich WHERE type = 'card') SELECT 'normal' AS density, doc_id, id FROM n WHERE kind IN ('key', 'trm', 'ctx') AND kind <> 'trm' UNION ALL SELECT 'low', doc_id, id FROM n WHERE kind = 'key' UNION ALL SELECT 'high', doc_id, id FROM n WHERE kind IN ('key', 'trm', 'ctx')")
def visible_notes(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["key", "trm", "ctx", "qst"]))
    notes = rich_blocks(spark, sf_dir).filter("type = 'card'").select("doc_id", "id", F.element_at(kinds, (F.col("ord") % 4 + 1).cast("int")).alias("kind"))
    shown = [O.visible_notes(notes, ["key", "trm", "ctx"], d).select(F.lit(d).alias("density"), "doc_id", "id") for d in ("normal", "low", "high")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("restore_candidates", f"WITH {RICH} SELECT doc_id, id, type FROM marked WHERE {_LIVE} AND NOT ref AND type IN ('tab', 'eq') AND length(text) % 3 > 0 AND NOT (type = 'tab' AND length(text) % 2 = 0)")
def restore_candidates(spark, sf_dir):
    n = F.length("text")
    return O.restore_candidates(rich_blocks(spark, sf_dir), trusted=n % 2 == 0, pictured=n % 3 > 0).select("doc_id", "id", "type")


@query("prose_lines", f"WITH {BLOCKS} SELECT doc_id, count(*) AS n FROM blocks WHERE regexp_matches(text, '\\p{{L}}{{2,}}[ \\t\\n\\r\\f\\v]*:[ \\t\\n\\r\\f\\v]*$') OR len(regexp_extract_all(text, '\\p{{L}}{{3,}}')) >= 4 OR (regexp_matches(text, '^\\p{{Lu}}\\p{{Ll}}') AND len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) >= 3) GROUP BY doc_id")
def prose_lines(spark, sf_dir):
    return blocks(table(spark, sf_dir, "documents")).filter(O.is_prose(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("sure_passages", f"WITH {RICH} SELECT type, count(*) AS n, CAST(sum((CASE WHEN type IN ('fig', 'tab') THEN length(text) >= 24 AND w >= 4 ELSE length(text) >= 40 AND w >= 6 END)::INT) AS BIGINT) AS sure FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM rich) GROUP BY type")
def sure_passages(spark, sf_dir):
    r = rich_blocks(spark, sf_dir)
    return r.groupBy("type").agg(F.count("*").alias("n"), F.count_if(O.sure_passage(F.col("type"), F.col("text"))).alias("sure"))


@query("contained_paths", "WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'documents/' || doc_id || '/a.png' WHEN 1 THEN '/documents/' || doc_id || '/a.png' WHEN 2 THEN 'documents/' || doc_id || '/../x.png' ELSE 'documents/' || (doc_id + 1) || '/a..b.png' END AS path FROM documents) SELECT doc_id, path FROM p WHERE left(path, 1) <> '/' AND NOT list_contains(string_split(path, '/'), '..') AND starts_with(path, 'documents/' || doc_id || '/')")
def contained_paths(spark, sf_dir):
    at = lambda form, shift=0: F.format_string(form, F.col("doc_id") + shift)
    path = F.when(F.col("doc_id") % 4 == 0, at("documents/%d/a.png")).when(F.col("doc_id") % 4 == 1, at("/documents/%d/a.png")).when(F.col("doc_id") % 4 == 2, at("documents/%d/../x.png")).otherwise(at("documents/%d/a..b.png", 1))
    p = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return p.filter(O.contained_path(F.col("path"), F.col("doc_id")))


@query("ocr_pages", f"WITH {BLOCKS}, p AS (SELECT DISTINCT doc_id, ord // 3 AS page, false AS has_text FROM blocks WHERE ord % 3 = 0 AND length(text) % 2 = 0), n AS (SELECT doc_id FROM p GROUP BY doc_id HAVING count(DISTINCT page) BETWEEN 1 AND 20) SELECT doc_id, page FROM p SEMI JOIN n USING (doc_id)")
def ocr_pages(spark, sf_dir):
    """Pages (three blocks) asked for, if they are at most 20 of a document."""
    b = blocks(table(spark, sf_dir, "documents")).filter((F.col("ord") % 3 == 0) & (F.length("text") % 2 == 0))
    return O.ocr_pages(b.select("doc_id", F.floor(F.col("ord") / 3).alias("page"), F.lit(False).alias("has_text"))).select("doc_id", "page")


@query("recoverable_jobs", "SELECT doc_id FROM documents WHERE length(source) % 2 = 0 AND doc_id % 5 < 3 AND doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def recoverable_jobs(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    jobs = docs.select("doc_id", F.when(F.length("source") % 2 == 0, "pdf").otherwise("html").alias("kind"), (F.col("doc_id") % 5).alias("revision"), (F.col("doc_id") % 7 == 0).alias("approved"))
    return O.recoverable(jobs, 3, labels.filter("quality = 1"), labels.filter("toxic = 1")).select("doc_id")


@query("ended_jobs", "SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def ended_jobs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return O.ended_jobs(labels.filter("quality = 0"), labels.filter("toxic = 1"), table(spark, sf_dir, "documents").filter("n_chars > 500")).distinct()


@query("section_window", f"WITH {RICH}, p AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) - 1 AS place, count(*) OVER (PARTITION BY doc_id, section) AS n FROM secs) SELECT doc_id, id, place, greatest(0, least(place - 12, n - 24)) AS start, least(n, 24) AS rows FROM p")
def section_window(spark, sf_dir):
    return O.section_window(rich_blocks(spark, sf_dir), ["doc_id", "section"], "ord").select("doc_id", "id", "place", "start", "rows")


@query("references_flag", f"WITH {RICH} SELECT doc_id, count(*) AS n, CAST(sum(ref::INT) AS BIGINT) AS refs FROM marked GROUP BY doc_id")
def references_flag(spark, sf_dir):
    """Rows from a heading of references up to the next heading."""
    return rich_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(O.in_references(F.col("section"))).alias("refs"))


@query("recent_item", "SELECT doc_id, ts FROM (SELECT e.user_id AS doc_id, e.ts, row_number() OVER (ORDER BY e.ts DESC, e.event_id DESC) AS k FROM events e JOIN documents d ON d.doc_id = e.user_id WHERE d.n_chars > 0) WHERE k = 1")
def recent_item(spark, sf_dir):
    """The item opened last that has any text."""
    e = table(spark, sf_dir, "events").join(table(spark, sf_dir, "documents").filter("n_chars > 0").select(F.col("doc_id").alias("user_id")), "user_id")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select(F.col("user_id").alias("doc_id"), "ts")


@query("unused_drafts", "SELECT conv_id FROM (SELECT conv_id, count(*) AS n, max(length(trim(text))) AS longest, bool_or(role = 'assistant') AS answered FROM conversations GROUP BY conv_id) WHERE NOT (n < 3 AND longest < 60 AND NOT answered)")
def unused_drafts(spark, sf_dir):
    """Conversations that stay when drafts without answer and text of note are dropped."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length(F.trim("text"))).alias("longest"), F.bool_or(F.col("role") == "assistant").alias("answered"))
    return g.filter("not (n < 3 and longest < 60 and not answered)").select("conv_id")


@query("selectable_changes", "WITH c AS (SELECT doc_id, ['same', 'added', 'changed', 'missing'][1 + doc_id % 4] AS kind, n_chars FROM documents) SELECT doc_id, kind, kind IN ('added', 'changed') AND n_chars > 300 AS requires_translation FROM c WHERE kind IN ('added', 'changed')")
def selectable_changes(spark, sf_dir):
    """Changes that a reader can choose, and whether choosing one means to translate again."""
    kinds = F.array(*map(F.lit, ["same", "added", "changed", "missing"]))
    c = table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"), "n_chars")
    return c.filter(F.col("kind").isin("added", "changed")).select("doc_id", "kind", (F.col("n_chars") > 300).alias("requires_translation"))
