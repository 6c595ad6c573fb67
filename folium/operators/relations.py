"""Operators between tables: latest rows, terms in texts, diffs, trees, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.sources.tables import settled

#: Terms that are sent to every task; more are shuffled.
TERMS = 100_000
#: The part of all references that one may be of before it is told apart.
OFTEN = 0.01


def latest(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The last row of each key. Combines before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(key, "r.*")


def missing_tokens(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: how many tokens of source (keys, token) the target lacks, counting repeats; extra ones are allowed."""
    a = source.groupBy(*keys, "token").agg(F.count("*").alias("a"))
    b = target.groupBy(*keys, "token").agg(F.count("*").alias("b"))
    short = F.greatest(F.col("a") - F.coalesce("b", F.lit(0)), F.lit(0))
    return a.join(b, [*keys, "token"], "left").groupBy(*keys).agg(F.sum(short).alias("n"))


def words_of(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep..., pos, token: lower-cased letters and digits in a row."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return rows.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def term_hits(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, first (ord), n: blocks (doc_id, ord, text) that hold a term (term) as a whole word. An equi join on tokens.

    Up to TERMS terms go to the words, so that no others are shuffled.
    """
    words = words_of(blocks, "text", "doc_id", "ord").select("doc_id", "ord", F.col("token").alias("term"))
    if terms.count() <= TERMS:
        words = words.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return words.distinct().join(terms, "term").groupBy("doc_id", "term").agg(F.min("ord").alias("first"), F.count("*").alias("n"))


def known_references(refs: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """by, n: how many references (by, ref) lead to a key (ref), for those with any.

    A reference that more than a part OFTEN of all rows share does not meet the others of its key in one task: it is held against the
    counted keys where it is. Which ones are told apart by this is a matter of cost only.
    """
    told = refs.filter("ref IS NOT NULL")
    often = told.stat.freqItems(["ref"], OFTEN).first()[0]
    hot = F.col("ref").isin(*often) if often else F.lit(False)
    few = keys.filter(hot).groupBy("ref").agg(F.count("*").alias("m"))
    rest = told.filter(~hot).join(keys.filter(~hot).select("ref"), "ref").select(by, F.lit(1).cast("bigint").alias("m"))
    met = told.filter(hot).join(F.broadcast(few), "ref").select(by, "m")
    return rest.unionByName(met).groupBy(by).agg(F.sum("m").alias("n"))


def locate(passages: DataFrame, texts: DataFrame, anchor: int = 4) -> DataFrame:
    """item_id, doc_id, n (texts that contain it): null doc_id unless it is exactly one.

    passages: item_id, text, of six words or more (shorter ones prove nothing); texts: doc_id, text; both normalised. Candidates share the passage's first `anchor` words
    (an equi join); containment is then tested.
    """
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - anchor + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, anchor), " ")))
    left = passages.select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(F.split("text", " "), 2, anchor), " ").alias("gram"))
    split = texts.select("doc_id", F.split("text", " ").alias("w"))
    keys = split.select("doc_id", F.explode(grams(F.col("w"))).alias("gram"))
    if left.count() <= 100_000:
        keys = keys.join(F.broadcast(left.select("gram").distinct()), "gram", "left_semi")
    pairs = keys.join(left, "gram").select("item_id", "doc_id", "passage").distinct()
    found = pairs.join(texts, "doc_id").filter(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    by_item = found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("one"))
    out = passages.select("item_id").join(by_item, "item_id", "left")
    return out.select("item_id", F.when(F.col("n") == 1, F.col("one")).alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n"))


def link_unique(old: DataFrame, new: DataFrame, scope: list[str], signature: str) -> DataFrame:
    """scope, old_id, new_id, kind: rows whose signature is unique on both sides are same; the rest are missing or added."""
    once = lambda df, x: df.withColumn("k", F.count("*").over(Window.partitionBy(*scope, signature))).filter("k = 1").select(*scope, signature, F.col("id").alias(x))
    same = once(old, "old_id").join(once(new, "new_id"), [*scope, signature]).select(*scope, "old_id", "new_id", F.lit("same").alias("kind"))
    gone = old.join(same.select(*scope, F.col("old_id").alias("id")), [*scope, "id"], "left_anti").select(*scope, F.col("id").alias("old_id"), F.lit(None).cast("bigint").alias("new_id"), F.lit("missing").alias("kind"))
    added = new.join(same.select(*scope, F.col("new_id").alias("id")), [*scope, "id"], "left_anti").select(*scope, F.lit(None).cast("bigint").alias("old_id"), F.col("id").alias("new_id"), F.lit("added").alias("kind"))
    return same.unionByName(gone).unionByName(added)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after `new` rows replace those of their keys; columns of old."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(old.columns))


def cascade_delete(gone: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def merged_status(old: Column, new: Column) -> Column:
    """One step: paused wins, unless the job is queued again."""
    return F.when((old == "paused") & (new != "queued"), old).otherwise(F.coalesce(new, old))


def merged_states(rows: DataFrame, w, paused: Column, queued: Column, status: Column, checkpoint: dict[str, Column]) -> DataFrame:
    """rows in the order of w with `held`: whether the job is paused, which wins until it is queued again; and each key of its checkpoint as last written."""
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(w)
    told = rows.withColumns({"_paused": F.when(paused, place), "_queued": F.when(queued, place)} | {name: F.last(c, ignorenulls=True).over(up_to) for name, c in checkpoint.items()})
    held = F.coalesce(F.max("_paused").over(up_to) > F.coalesce(F.max("_queued").over(up_to), F.lit(0)), F.lit(False))
    return told.withColumn("held", held & status.isNotNull()).drop("_paused", "_queued")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth: all nodes under the roots along edges (parent, child), the roots themselves at 0; each at its least depth, so cycles end."""
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    now, depth = seen, 0
    while True:
        depth += 1
        step = now.join(edges, now["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        now = settled(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if now.isEmpty():
            return seen
        seen = settled(seen.unionByName(now)) if depth % 8 == 0 else seen.unionByName(now)


def overlap(a: str, b: str) -> Column:
    """Area of the intersection of rectangles a and b (x0, y0, x1, y1)."""
    c = F.col
    wide = F.least(c(f"{a}.x1"), c(f"{b}.x1")) - F.greatest(c(f"{a}.x0"), c(f"{b}.x0"))
    high = F.least(c(f"{a}.y1"), c(f"{b}.y1")) - F.greatest(c(f"{a}.y0"), c(f"{b}.y0"))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
