"""Rules on contents: what rewriting must keep, answers and messages, estimates, pages, snapshots, and the batch form of deltas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import content as C
from folium.operators.changes import replaced
from folium.sources.tables import blocks, table

from .queries_filters import RICH, rich_blocks
from .registry import BLOCKS, registry

QUERIES, SQL, query = registry()

#: Texts with numbers, a percentage, a formula and raised text, and a rewriting in which every third lacks some of them.
_PAIRS = r"""p AS (SELECT conv_id, turn, text || ' 12% of ' || conv_id || ' and 7 percent, \(a_' || turn || '\) x<sup>2</sup> ' || turn AS src,
  text || CASE WHEN (conv_id + turn) % 3 = 0 THEN ' 12 of ' || conv_id || ', x<sub>2</sub>' ELSE ' ' || turn || ' 12% \(a_' || turn || '\) 7% x<sup>2</sup> ' || conv_id END AS dst FROM conversations WHERE text IS NOT NULL)"""
_NUM = r"regexp_extract_all(regexp_replace(replace({t}, '−', '-'), '(?i)[ \t\n\r\f\v]*(?:percent|퍼센트)', '%', 'g'), '(?:^|[^A-Za-z0-9_.])([-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?%?)', 1)"
_FORM = r"regexp_extract_all({t}, '\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$')"
_SCRIPT = "list_transform(regexp_extract_all({t}, '<(?:sub|sup)>[^<]*</(?:sub|sup)>'), lambda s: s[2:4] || ':' || regexp_extract(s, '>([^<]*)<', 1))"


def _short(name: str, of: str) -> str:
    """Elements of the source list that the other lacks, repeats counted."""
    a, b = of.format(t="src"), of.format(t="dst")
    return f"CAST(list_sum(list_transform(list_distinct({a}), lambda v: greatest(len(list_filter({a}, lambda x: x = v)) - len(list_filter({b}, lambda x: x = v)), 0))) AS BIGINT) AS {name}"


_PLAIN = f"list_transform({_NUM}, lambda n: rtrim(n, '%'))"
_PCT = f"list_filter({_NUM}, lambda n: right(n, 1) = '%')"


@query("content_validation", f"WITH {_PAIRS} SELECT conv_id, turn, coalesce(numbers, 0) AS numbers, coalesce(percentages, 0) AS percentages, coalesce(formulas, 0) AS formulas, coalesce(scripts, 0) AS scripts FROM (SELECT conv_id, turn, {_short('numbers', _PLAIN)}, {_short('percentages', _PCT)}, {_short('formulas', _FORM)}, {_short('scripts', _SCRIPT)} FROM p)")
def content_validation(spark, sf_dir):
    """Numbers, percentages, formulas and scripts that a rewritten message has lost."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    src = F.concat("text", F.lit(" 12% of "), conv, F.lit(" and 7 percent, \\(a_"), turn, F.lit("\\) x<sup>2</sup> "), turn)
    good = F.concat(F.lit(" "), turn, F.lit(" 12% \\(a_"), turn, F.lit("\\) 7% x<sup>2</sup> "), conv)
    dst = F.concat("text", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit(" 12 of "), conv, F.lit(", x<sub>2</sub>"))).otherwise(good))
    return c.select("conv_id", "turn", src.alias("src"), dst.alias("dst")).select("conv_id", "turn", C.lost(F.col("src"), F.col("dst")).alias("l")).select("conv_id", "turn", "l.*")


@query("plain_texts", "SELECT page_id, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS sha FROM (SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS t FROM pages WHERE html IS NOT NULL)")
def plain_texts(spark, sf_dir):
    t = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", C.plain_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("sha"))


@query("fenced_answers", "SELECT conv_id, turn, turn + 1 AS value, turn % 3 = 0 AS broken FROM conversations")
def fenced_answers(spark, sf_dir):
    """Answers in JSON, most of them in fences; those that cannot be read are broken."""
    n = (F.col("turn") + 1).cast("string")
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"value": '), n)).otherwise(F.concat(F.lit('{"value": '), n, F.lit("}")))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.unfenced(text).alias("t"))
    parsed = F.try_parse_json("t")
    return t.select("conv_id", "turn", F.coalesce(F.try_variant_get(parsed, "$.value", "bigint"), F.col("turn") + 1).alias("value"), parsed.isNull().alias("broken"))


@query("model_names", "SELECT doc_id, 'M' || doc_id AS names FROM documents WHERE text IS NOT NULL")
def model_names(spark, sf_dir):
    """Names that a text introduces, each once."""
    lead = F.format_string("We propose M%d. Then we introduce M%d. ", "doc_id", "doc_id")
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(lead, F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join(C.model_names(F.col("t")), ",").alias("names"))


@query("data_urls", "SELECT page_id, sha256('data:text/html;base64,' || to_base64(encode(html))) AS sha FROM pages WHERE html IS NOT NULL")
def data_urls(spark, sf_dir):
    url = F.regexp_replace(C.data_url(F.encode("html", "UTF-8"), "text/html"), "[\r\n]", "")
    return table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.sha2(url, 256).alias("sha"))


@query("picture_sizes", "SELECT page_id, CASE WHEN page_id % 3 = 0 OR (page_id % 5000 + 1) * 9000 > 40000000 THEN NULL ELSE (page_id % 5000 + 1) * 9000 END AS pixels FROM pages")
def picture_sizes(spark, sf_dir):
    """Pixels from the header of pictures: of a third it is not one, and some are too large."""
    lead = F.when(F.col("page_id") % 3 == 0, "89504E470D0A1A0B").otherwise("89504E470D0A1A0A")
    side = lambda x: F.lpad(F.hex(x), 8, "0")
    content = F.unhex(F.concat(lead, F.lit("0000000D49484452"), side((F.col("page_id") % 5000 + 1).cast("bigint")), side(F.lit(9000).cast("bigint")), F.lit("0806000000")))
    return table(spark, sf_dir, "pages").select("page_id", C.picture_size(content).alias("pixels"))


@query("error_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN c IN (408, 409, 425, 429) OR c >= 500 THEN 'transient' WHEN c IN (400, 413, 422) THEN 'soft' WHEN c >= 400 THEN 'fatal' END AS class FROM (SELECT 395 + event_id % 120 AS c FROM events)) GROUP BY class")
def error_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C.error_class(F.col("event_id") % 120 + 395).alias("class"))
    return e.groupBy("class").agg(F.count("*").alias("n"))


@query("compact_messages", "SELECT conv_id, turn, CASE role WHEN 'user' THEN '{\"text\":' || length(text) || '}' ELSE '{\"chars\":' || length(text) || ',\"turn\":' || turn || '}' END AS data FROM conversations WHERE text IS NOT NULL")
def compact_messages(spark, sf_dir):
    """By role, the part of a message's snapshot that a list needs."""
    snapshot = F.struct(F.length("text").alias("chars"), F.length("text").alias("text"), "turn", "role")
    c = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "role", F.parse_json(F.to_json(snapshot)).alias("v"))
    get = lambda name: F.variant_get("v", f"$.{name}", "bigint")
    user, other = F.to_json(F.struct(get("text").alias("text"))), F.to_json(F.struct(get("chars").alias("chars"), get("turn").alias("turn")))
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", user).otherwise(other).alias("data"))


@query("summary_estimates", f"WITH {BLOCKS}, s AS (SELECT doc_id, sum(length(text)) AS chars, max(ord // 10) + 1 AS groups FROM blocks GROUP BY doc_id) SELECT doc_id, groups + 1 AS calls, CAST(floor(chars / 3) + (groups + 1) * 700 + groups * 500 AS BIGINT) AS tokens_in, groups * 600 + 1800 AS tokens_out FROM s")
def summary_estimates(spark, sf_dir):
    """Calls and tokens of a two-level summary, with a call for each group of ten blocks and one for all."""
    s = blocks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), (F.max(F.floor(F.col("ord") / 10)) + 1).alias("groups"))
    return s.select("doc_id", (F.col("groups") + 1).alias("calls"), (F.floor(F.col("chars") / 3) + (F.col("groups") + 1) * 700 + F.col("groups") * 500).cast("bigint").alias("tokens_in"), (F.col("groups") * 600 + 1800).alias("tokens_out"))


@query("page_counts", f"WITH {BLOCKS}, p AS (SELECT doc_id, ord // 8 AS page, bool_or(ord % 8 <> 0) AS has_text, bool_or(ord % 8 = 5) AS has_ocr FROM blocks GROUP BY ALL) SELECT doc_id, count(*) AS total, CAST(sum(has_text::INT) AS BIGINT) AS with_text, coalesce(string_agg(page, ',' ORDER BY page) FILTER (NOT has_text), '') AS without_text, CAST(sum(has_ocr::INT) AS BIGINT) AS with_ocr FROM p GROUP BY doc_id")
def page_counts(spark, sf_dir):
    """Pages of a document (of eight blocks), with and without text, and with recognised text."""
    page = F.floor(F.col("ord") / 8)
    p = blocks(table(spark, sf_dir, "documents")).groupBy("doc_id", page.alias("page")).agg(F.bool_or(F.col("ord") % 8 != 0).alias("has_text"), F.bool_or(F.col("ord") % 8 == 5).alias("has_ocr"))
    without = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("has_text"), F.col("page")))), lambda x: x.cast("string")), ",")
    return p.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("has_text").alias("with_text"), without.alias("without_text"), F.count_if("has_ocr").alias("with_ocr"))


@query("stage_audit", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS tokens, round(max(value), 4) AS largest, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stage_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.max("value"), 4).alias("largest"), F.countDistinct("user_id").alias("users"))


@query("next_order", "SELECT d.doc_id, coalesce(max(o_orderkey), -1) + 1 AS next FROM documents d LEFT JOIN orders ON o_custkey = doc_id GROUP BY d.doc_id")
def next_order(spark, sf_dir):
    """The place of a row that is added: after the last, or 0."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max("o_orderkey").alias("last"))
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(-1)) + 1).alias("next"))


@query("replaced_extraction", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 4 = 1 AND n_chars > 100")
def replaced_extraction(spark, sf_dir):
    """Documents extracted again: all old rows go, what the new extraction has comes."""
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    again = old.filter("doc_id % 4 = 1")
    new = again.filter("n_chars > 100").select("doc_id", F.lit("new").alias("lang"))
    return replaced(old.select("doc_id", "lang"), again.select("doc_id").distinct(), new, "doc_id")


@query("valid_positions", f"WITH {BLOCKS} SELECT b.doc_id, b.ord FROM blocks b WHERE b.ord = b.doc_id % 40")
def valid_positions(spark, sf_dir):
    """Reading positions that are a block of their document; others are not stored."""
    b = blocks(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("ord"))
    return asked.join(b.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")


@query("source_texts", f"WITH {RICH} SELECT doc_id, id, CAST(length(t) AS BIGINT) AS chars FROM (SELECT doc_id, id, concat_ws(' ', CASE WHEN type IN ('tab', 'fig', 'eq') THEN CAST(ord AS VARCHAR) END, CASE WHEN type NOT IN ('tab', 'fig') THEN text END, CASE WHEN type IN ('tab', 'fig') THEN text END) AS t FROM rich)")
def source_texts(spark, sf_dir):
    """Number, text and caption of a block in one string."""
    visual = F.col("type").isin("tab", "fig")
    t = F.concat_ws(" ", F.when(F.col("type").isin("tab", "fig", "eq"), F.col("ord").cast("string")), F.when(~visual, F.col("text")), F.when(visual, F.col("text")))
    return rich_blocks(spark, sf_dir).select("doc_id", "id", F.length(t).cast("bigint").alias("chars"))


@query("section_names", f"WITH {RICH} SELECT doc_id, id, coalesce(CASE WHEN section IS NOT NULL THEN section END, 'Start') AS name FROM secs WHERE type = 'p'")
def section_names(spark, sf_dir):
    return rich_blocks(spark, sf_dir).filter("type = 'p'").select("doc_id", "id", F.coalesce("section", F.lit("Start")).alias("name"))


@query("thread_titles", "SELECT conv_id, left(coalesce(nullif(trim(max(CASE WHEN turn = 0 AND role = 'user' THEN text END)), ''), nullif(trim(max(CASE WHEN turn = 1 THEN text END)), ''), 'Conversation ' || conv_id), 120) AS title FROM conversations GROUP BY conv_id")
def thread_titles(spark, sf_dir):
    """The first question, else the answer, else a label; 120 characters."""
    first = lambda c: F.nullif(F.trim(F.max(F.when(c, F.col("text")))), F.lit(""))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first((F.col("turn") == 0) & (F.col("role") == "user")).alias("a"), first(F.col("turn") == 1).alias("b"))
    return g.select("conv_id", F.substring(F.coalesce("a", "b", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))), 1, 120).alias("title"))


@query("kept_memos", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND conv_id % 5 <> 0")
def kept_memos(spark, sf_dir):
    """Answers that become memos: not empty, and none that is kept already."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''").select("conv_id", "turn")
    return c.join(c.filter("conv_id % 5 = 0"), ["conv_id", "turn"], "left_anti")


@query("interrupted_runs", "SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'view' THEN 'interrupted' ELSE arg_max(event_type, (ts, event_id)) END AS status FROM events GROUP BY user_id")
def interrupted_runs(spark, sf_dir):
    """After a restart, what was running (view) is interrupted."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", F.when(F.col("last") == "view", "interrupted").otherwise(F.col("last")).alias("status"))


@query("joined_deltas", "SELECT conv_id, sha256(left(string_agg(text, '' ORDER BY turn, role, text), 1000)) AS sha, CAST(least(sum(length(text)), 1000) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def joined_deltas(spark, sf_dir):
    """Deltas of an answer in order, up to a limit; the batch form of the stream."""
    g = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ds"))
    text = F.substring(F.array_join(F.transform("ds", lambda d: d["text"]), ""), 1, 1000)
    return g.select("conv_id", F.sha2(text, 256).alias("sha"), F.length(text).cast("bigint").alias("chars"))


@query("line_offsets", f"WITH {BLOCKS} SELECT doc_id, ord, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS chars FROM blocks")
def line_offsets(spark, sf_dir):
    """Where each line starts in the text of its document."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("bigint")
    return blocks(table(spark, sf_dir, "documents")).select("doc_id", "ord", start.alias("start"), F.length("text").cast("bigint").alias("chars"))


@query("visual_matches", "WITH h AS (SELECT o_custkey AS doc, o_orderpriority AS label, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_custkey AS doc, o_orderpriority AS label, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 1), h1 AS (SELECT doc, label, min(id) AS a, count(*) AS n FROM h GROUP BY ALL), p1 AS (SELECT doc, label, min(id) AS b, count(*) AS n FROM p GROUP BY ALL), j AS (SELECT h1.doc, h1.label, a, b, h1.n = 1 AND coalesce(p1.n, 0) = 1 AS ok FROM h1 LEFT JOIN p1 USING (doc, label)) SELECT doc, label, a, b FROM j QUALIFY bool_and(ok) OVER (PARTITION BY doc)")
def visual_matches(spark, sf_dir):
    """Visuals of two sources with one label, unique on both sides; if one of a document has no match, none has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"))
    side = lambda rows, x: rows.groupBy("doc", "label").agg(F.min("id").alias(x), F.count("*").alias(f"n{x}"))
    j = side(o.filter("id % 2 = 0"), "a").join(side(o.filter("id % 2 = 1"), "b"), ["doc", "label"], "left")
    ok = (F.col("na") == 1) & (F.coalesce("nb", F.lit(0)) == 1)
    return j.withColumn("all_ok", F.bool_and(ok).over(Window.partitionBy("doc"))).filter("all_ok").select("doc", "label", "a", "b")


@query("positional_pairs", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) SELECT x.l_orderkey, x.k, x.l_partkey AS a, y.l_suppkey AS b FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.k = y.k")
def positional_pairs(spark, sf_dir):
    """Rows and their sources, by position."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    li = table(spark, sf_dir, "lineitem").withColumn("k", place)
    return li.select("l_orderkey", "k", F.col("l_partkey").alias("a")).join(li.select("l_orderkey", "k", F.col("l_suppkey").alias("b")), ["l_orderkey", "k"])


@query("notes_export", f"WITH {RICH} SELECT doc_id, sha256(string_agg(k || '. ' || text, chr(10) ORDER BY k)) AS sha, count(*) AS notes FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord, id) AS k FROM rich WHERE type = 'card') GROUP BY doc_id")
def notes_export(spark, sf_dir):
    """Notes of a document, numbered."""
    g = rich_blocks(spark, sf_dir).filter("type = 'card'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "text"))).alias("ns"))
    lines = F.transform("ns", lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n["text"]))
    return g.select("doc_id", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"), F.size("ns").cast("bigint").alias("notes"))


@query("html_export", f"WITH {BLOCKS} SELECT doc_id, sha256('<script>' || replace(replace(replace(string_agg(text, chr(10) ORDER BY ord), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '</script>') AS sha FROM blocks GROUP BY doc_id")
def html_export(spark, sf_dir):
    """A document's text inside a page, with what could end the script escaped."""
    g = blocks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("t"))
    safe = F.col("t")
    for c, by in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        safe = F.replace(safe, F.lit(c), F.lit(by))
    return g.select("doc_id", F.sha2(F.concat(F.lit("<script>"), safe, F.lit("</script>")), 256).alias("sha"))


@query("numeric_cells", "SELECT l_orderkey, count(*) AS cells, CAST(sum(regexp_full_match(t, '[-+]?[0-9]+([.,][0-9]+)*%?')::INT) AS BIGINT) AS numeric FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN l_returnflag WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '%' ELSE CAST(l_partkey AS VARCHAR) END AS t FROM lineitem) GROUP BY l_orderkey")
def numeric_cells(spark, sf_dir):
    """Cells that are nothing but a number."""
    part = F.col("l_partkey").cast("string")
    t = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).when(F.col("l_linenumber") % 3 == 1, F.concat(part, F.lit("%"))).otherwise(part)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", t.alias("t")).groupBy("l_orderkey").agg(F.count("*").alias("cells"), F.count_if(F.col("t").rlike("^[-+]?[0-9]+([.,][0-9]+)*%?$")).alias("numeric"))
