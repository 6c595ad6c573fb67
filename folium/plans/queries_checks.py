"""Diagnostics with their severities, rectangles, markup, answers of models and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.operators import diagnostics as O
from folium.operators.relations import overlap
from folium.sources.tables import blocks, table

from .queries_filters import RICH, rich_blocks
from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

_STATE = f"""{RICH}, st AS (SELECT *, doc_id % 5 = 0 AS busy, doc_id % 3 > 0 AS approved, ord % 2 = 0 AS fallback, ord % 13 = 3 AS image_broken, ord % 29 = 3 AS restore_error, ord % 4 = 0 AS restored, ord % 9 = 1 AS rejected, ord % 3 > 0 AS translated FROM marked WHERE type <> 'card' AND NOT superseded),
tg AS (SELECT *, NOT ref AND type IN ('sec', 'sub', 'ssub', 'p', 'li', 'tab', 'fig') AS target FROM st),
i AS (SELECT doc_id, id, 'visual_pdf_fallback' AS rule, 'info' AS severity FROM tg WHERE type IN ('fig', 'tab') AND fallback
  UNION ALL SELECT doc_id, id, 'missing_image', CASE WHEN busy THEN 'info' ELSE 'attention' END FROM tg WHERE image_broken
  UNION ALL SELECT doc_id, id, 'restore_failed', 'attention' FROM tg WHERE restore_error
  UNION ALL SELECT doc_id, id, 'restore_pending', 'info' FROM tg WHERE NOT restore_error AND NOT image_broken AND type IN ('tab', 'eq') AND NOT restored
  UNION ALL SELECT doc_id, id, 'translation_rejected', CASE WHEN translated OR busy THEN 'info' ELSE 'attention' END FROM tg WHERE target AND rejected
  UNION ALL SELECT doc_id, id, 'untranslated', CASE WHEN busy OR NOT approved THEN 'info' ELSE 'attention' END FROM tg WHERE target AND NOT rejected AND NOT translated),
pg AS (SELECT doc_id, ord // 8 AS page, bool_or(ord % 8 > 0) AS has_text, bool_or(ord % 40 = 5) AS recognised, bool_or(ord % 24 = 20) AS met FROM blocks GROUP BY ALL),
pi AS (SELECT doc_id, page, CASE WHEN recognised THEN 'ocr_recognized' WHEN NOT has_text THEN 'page_without_text' WHEN NOT met THEN 'unmatched_source' END AS rule FROM pg)"""


def _issues(spark, sf_dir):
    o = F.col("ord")
    state = {"busy": F.col("doc_id") % 5 == 0, "approved": F.col("doc_id") % 3 > 0, "fallback": o % 2 == 0, "image_broken": o % 13 == 3, "restore_error": o % 29 == 3, "restored": o % 4 == 0, "rejected": o % 9 == 1, "translated": o % 3 > 0}
    return O.block_issues(rich_blocks(spark, sf_dir).withColumns(state))


@query("block_issues", f"WITH {_STATE} SELECT * FROM i")
def block_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@query("issue_counts", f"WITH {_STATE} SELECT rule, severity, count(*) AS n FROM (SELECT rule, severity FROM i UNION ALL SELECT rule, 'info' FROM pi WHERE rule IS NOT NULL) GROUP BY ALL")
def issue_counts(spark, sf_dir):
    """Issues of blocks and of pages (eight blocks each) by rule and severity."""
    b = blocks(table(spark, sf_dir, "documents")).withColumn("page", F.floor(F.col("ord") / 8))
    pages = b.groupBy("doc_id", "page").agg(F.bool_or(F.col("ord") % 8 > 0).alias("has_text"), F.bool_or(F.col("ord") % 40 == 5).alias("recognised"))
    return O.by_kind(_issues(spark, sf_dir), O.page_issues(pages, b.filter("ord % 24 = 20")))


_BOX = "SELECT l_orderkey AS page, l_linenumber AS k, l_partkey, l_quantity - 5 AS x0, l_discount * 100 - 2 AS y0, l_quantity + l_suppkey % 9 - 5 AS x1, l_discount * 100 + l_partkey % 7 - 2 AS y1 FROM lineitem"


def _boxes(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("k"), "l_partkey", (q - 5).alias("x0"), (d - 2).alias("y0"), (q + F.col("l_suppkey") % 9 - 5).alias("x1"), (d + F.col("l_partkey") % 7 - 2).alias("y1"))


@query("clipped_boxes", f"SELECT page, k, l_partkey, round(greatest(x0, 0), 4) AS x0, round(greatest(y0, 0), 4) AS y0, round(least(x1, 40), 4) AS x1, round(least(y1, 6), 4) AS y1 FROM ({_BOX}) WHERE x0 < x1 AND y0 < y1 AND x0 < 40 AND y0 < 6 AND x1 > 0 AND y1 > 0")
def clipped_boxes(spark, sf_dir):
    """Rectangles cut to their page; those that are not ordered or lie outside go."""
    c = O.clipped(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 40.0, 6.0)
    told = _boxes(spark, sf_dir).select("page", "k", "l_partkey", c.alias("c")).filter("c is not null")
    return told.select("page", "k", "l_partkey", *(F.round(f"c.{x}", 4).alias(x) for x in ("x0", "y0", "x1", "y1")))


@query("lines_outside_regions", f"WITH r AS ({_BOX}), l AS (SELECT * FROM r WHERE k > 1), g AS (SELECT * FROM r WHERE k = 1) SELECT page, k, l_partkey FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page = l.page AND greatest(least(l.x1, g.x1) - greatest(l.x0, g.x0), 0) * greatest(least(l.y1, g.y1) - greatest(l.y0, g.y0), 0) > 0.55 * (l.x1 - l.x0) * (l.y1 - l.y0))")
def lines_outside_regions(spark, sf_dir):
    """Lines that no region of their page covers by more than 55 percent."""
    r = _boxes(spark, sf_dir)
    line, region = r.filter("k > 1").alias("l"), r.filter("k = 1").alias("g")
    covered = (F.col("l.page") == F.col("g.page")) & (overlap("l", "g") > 0.55 * (F.col("l.x1") - F.col("l.x0")) * (F.col("l.y1") - F.col("l.y0")))
    return line.join(region, covered, "left_anti").select("page", "k", "l_partkey")


@query("original_images", f"SELECT page, count(*) AS images FROM (SELECT DISTINCT page, x0, y0, x1, y1 FROM ({_BOX}) WHERE x1 - x0 >= 2.4 AND y1 - y0 >= 2.4 AND (x1 - x0) * (y1 - y0) >= 9.5) GROUP BY page")
def original_images(spark, sf_dir):
    """Images of a page that are large enough, each place once (lengths are in tens of points here)."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    big = _boxes(spark, sf_dir).filter((wide >= 2.4) & (high >= 2.4) & (wide * high >= 9.5)).select("page", "x0", "y0", "x1", "y1").distinct()
    return big.groupBy("page").agg(F.count("*").alias("images"))


@query("sanitised_markup", "SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|iframe)\\b.*?</(?:script|style|iframe)>', '', 'g'), '(?i)<(/?)(?:strong|mark)\\b[^>]*>', '<\\1b>', 'g'), '(?i)<(/?)em\\b[^>]*>', '<\\1i>', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>', '<\\1>', 'g')) AS sha FROM pages WHERE html IS NOT NULL")
def sanitised_markup(spark, sf_dir):
    """Pages without active parts and attributes, emphasis as b and i."""
    t = F.col("html")
    for pattern, by in ((r"(?is)<(?:script|style|iframe)\b.*?</(?:script|style|iframe)>", ""), (r"(?i)<(/?)(?:strong|mark)\b[^>]*>", "<$1b>"), (r"(?i)<(/?)em\b[^>]*>", "<$1i>"), (r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>", "<$1>")):
        t = F.regexp_replace(t, pattern, by)
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.sha2(t, 256).alias("sha"))


@query("parsed_glossaries", "SELECT conv_id, turn, 't' || turn || ',x' AS terms FROM conversations")
def parsed_glossaries(spark, sf_dir):
    """Glossaries in answers, lists or objects: entries without a target and repeated terms go."""
    one = F.concat(F.lit('[{"term":"t'), F.col("turn").cast("string"), F.lit('","target":"a"},{"term":"T'), F.col("turn").cast("string"), F.lit('","target":"b"},{"term":"y","target":" "},{"term":"x","target":"c"}]'))
    answer = F.when(F.col("turn") % 2 == 0, one).otherwise(F.concat(F.lit('{"terms":'), one, F.lit("}")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", O.glossary(answer).alias("g"))
    return c.select("conv_id", "turn", F.array_join(F.transform("g", lambda e: e["term"]), ",").alias("terms"))


@query("read_answers", "SELECT conv_id, turn, length(text) AS chars, turn * 10 AS tokens, turn % 4 = 3 AS cut FROM conversations WHERE text IS NOT NULL")
def read_answers(spark, sf_dir):
    """Text, tokens and whether a limit cut it, from a provider's response."""
    reason = F.when(F.col("turn") % 4 == 3, "max_tokens").otherwise("end_turn")
    response = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), F.struct((F.col("turn") * 10).alias("output_tokens")).alias("usage"), reason.alias("stop_reason")))
    v = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.try_parse_json(response).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return v.select("conv_id", "turn", F.length(get("$.content[0].text", "string")).cast("bigint").alias("chars"), get("$.usage.output_tokens", "bigint").alias("tokens"), (get("$.stop_reason", "string") == "max_tokens").alias("cut"))


@query("paper_ids", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') END AS paper, CASE WHEN page_id % 3 = 1 THEN 1 + page_id % 4 END AS version FROM pages")
def paper_ids(spark, sf_dir):
    """Canonical id and version of a paper from an address or a bare id; null if there is none."""
    number = F.concat(F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0"))
    version = F.concat(F.lit("v"), (F.col("page_id") % 4 + 1).cast("string"))
    given = F.when(F.col("page_id") % 3 == 0, number).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://example.org/abs/"), number, version, F.lit("?x=1"))).otherwise(F.lit("no id 12.34"))
    part = lambda k: F.nullif(F.regexp_extract(given, r"(?:^|/)(\d{4}\.\d{4,5})(?:v(\d+))?(?:[?#].*)?$", k), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", part(1).alias("paper"), part(2).cast("bigint").alias("version"))


@query("manifest_changes", f"WITH {BLOCKS} SELECT doc_id, id, CASE WHEN ord % 2 = 0 THEN 'added' ELSE 'missing' END AS kind FROM blocks WHERE ord < 4 AND ord % 3 < 2 AND doc_id % 6 > 0")
def manifest_changes(spark, sf_dir):
    """Changes in the manifests of a reanalysis that have not been applied; manifests that cannot be read have none."""
    b = blocks(table(spark, sf_dir, "documents")).filter("ord < 4")
    change = F.struct("id", F.when(F.col("ord") % 2 == 0, "added").otherwise("missing").alias("kind"), (F.col("ord") % 3 == 2).alias("applied"))
    text = F.to_json(F.struct(F.collect_list(change).alias("changes")))
    files = b.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.substring("t", 2, 1 << 20)).otherwise(F.col("t")).alias("t"))
    read = F.from_json("t", "struct<changes:array<struct<id:string,kind:string,applied:boolean>>>")["changes"]
    return files.select("doc_id", F.explode(read).alias("c")).filter("not c.applied").select("doc_id", "c.id", "c.kind")


@query("checked_points", "SELECT o_custkey, count(*) FILTER (o_orderkey % 4 > 0) AS points, CAST(coalesce(sum((o_orderkey % 4 > 0 AND o_orderkey % 3 > 0)::INT), 0) AS BIGINT) AS refs FROM orders GROUP BY o_custkey")
def checked_points(spark, sf_dir):
    """Claims of a digest: those without text go; unknown references are taken off, and their claims stay."""
    point = F.struct(F.when(F.col("o_orderkey") % 4 > 0, "text").otherwise(" ").alias("text"), F.array("o_orderkey", F.lit(-1).cast("bigint")).alias("refs"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(point).alias("ps"))
    kept = F.transform(F.filter("ps", lambda p: F.trim(p["text"]) != ""), lambda p: F.filter(F.array_distinct(p["refs"]), lambda r: (r > 0) & (r % 3 > 0)))
    return g.select("o_custkey", F.size(kept).cast("bigint").alias("points"), F.size(F.flatten(kept)).cast("bigint").alias("refs"))


@query("minutes_ago", "SELECT event_id, (epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(ts)) // 60000000 AS minutes FROM events")
def minutes_ago(spark, sf_dir):
    at = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_diff("MINUTE", F.col("ts").cast("timestamp_ntz"), at).alias("minutes"))
