"""Fingerprints of documents: invertible Bloom lookup sketches of their paragraphs, by built-in functions only.

A paragraph is a line; a longer line is cut after the first sentence end at which a piece has 60 characters. A sketch has three
tables of cells; each distinct paragraph digest (48 bits of a hash and 16 that check them) goes to one cell in each, which holds how
many came and their XOR. The sketches of two versions subtract cell by cell, and what both have cancels out; then a
cell with one digest left names it, it is taken out of its other cells, and so on (`peeled`), until the digests that only
one version has are all known. Their number gives the likeness: of all distinct digests of both, the share that both have.

Peeling fails where the difference is too large for the cells. The string that is returned is a sketch of 3 * TABLE cells;
`compare_fingerprints` works on two of them alone and gives null where they are too small. `compare` makes sketches as large as the paragraphs of
both versions may need; their cells are rows that Spark sums, and each turn of the peeling is an aggregation of them. A
row's cells stay in one partition from the first sum to the last. Pairs that fail are tried again with twice the cells and other hashes, until none is left.

Cases: a null text is an empty one; texts without a paragraph are all alike (likeness 1); repeated rows have results each;
rows without doc_id follow all others; rows with one doc_id follow each other in the order of a hash of their texts; an empty table
gives an empty result; other columns are ignored, whatever their names. Repeated paragraphs of one text count once.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

#: Lines, cut after the first sentence end at which a piece has 60 characters or more.
PARAGRAPH = r"[^\n]{59}[^\n]*?[.!?](?=[ \n]|$)|[^\n]+"
#: Cells in each of the three tables of a block, a power of 2.
TABLE = 8
#: The least and most cells in a table of the sketches that are compared, and how many digests of both versions together come to one at most: so few that two rounds nearly always do.
LEAST, MOST, LOAD = 16, 1 << 24, 0.6
#: Rounds of peeling; each takes the single digests of each table in turn.
ROUNDS = 2
#: Digests that one task sums to cells and peels.
TASK_DIGESTS = 300_000
#: How often a pair that fails is tried again.
RETRIES = 12
#: Rows of neighbouring ids that are put in order by one task, up to so many groups.
ROWS = 1000
GROUPS = 16_384

_CHECK = (1 << 16) - 1
_TABLES = range(3)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _checked(h: Column) -> Column:
    """A hash whose last 16 bits check the others."""
    top = F.shiftright(h, 16)
    return F.shiftleft(top, 16).bitwiseXOR(F.xxhash64(top).bitwiseAND(F.lit(_CHECK)))


def _checks(digest: Column) -> Column:
    return F.xxhash64(F.shiftright(digest, 16)).bitwiseXOR(digest).bitwiseAND(F.lit(_CHECK)) == 0


def _places(digest: Column, table: Column, salt: Column, *more: Column) -> Column:
    """A struct of the digest's places p0, p1, p2 in the three tables, and more."""
    place = lambda h, i: F.shiftrightunsigned(h, 10 * i).bitwiseAND(table.cast("bigint") - 1).cast("int").alias(f"p{i}")
    return _let(F.xxhash64(digest, salt), lambda h: F.struct(*more, *(place(h, i) for i in _TABLES)))


def _first() -> tuple[Column, Column]:
    """Cells in a table and salt of the first size."""
    return F.lit(TABLE), F.lit(0)


def paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: _checked(F.xxhash64(p)))


def _cell(n: Column, k: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("bigint"))


def sketch(digests: Column, table: Column, salt: Column) -> Column:
    """The cells of digests, the three tables one after another."""
    placed = F.transform(digests, lambda d: _places(d, table, salt, d.alias("k"), F.lit(1).alias("n")))
    add = lambda c, e: _cell(c["n"] + e["n"], c["k"].bitwiseXOR(e["k"]))

    def tables(all_: Column) -> Column:
        one = lambda i: F.transform(F.sequence(F.lit(0), table - 1), lambda cell: F.aggregate(F.filter(all_, lambda e: e[f"p{i}"] == cell), _zero(), add))
        return F.concat(*(one(i) for i in _TABLES))

    return _let(placed, tables)


def peeled(cells: Column, table: Column, salt: Column) -> Column:
    """ok, and found: the digests k left in the difference, n 1 if only the left has it, -1 if only the right.

    Each turn takes out the digests that are alone in a cell of one table; there each is in one cell only.
    """
    less = lambda c, e: _cell(c["n"] - e["n"], c["k"].bitwiseXOR(e["k"]))

    def out(state: Column, e: Column) -> Column:
        def left(i: int) -> Column:
            cells, at = state[f"t{i}"], e[f"p{i}"]
            return F.concat(F.slice(cells, F.lit(1), at), F.array(less(cells[at], e)), F.slice(cells, at + 2, table))

        found = F.concat(state["found"], F.array(F.struct(e["k"].alias("k"), e["n"].alias("n"))))
        return F.struct(*(left(i).alias(f"t{i}") for i in _TABLES), found.alias("found"), F.lit(0).alias("idle"))

    def turn(state: Column, k: int) -> Column:
        alone = F.filter(state[f"t{k}"], lambda c: (F.abs(c["n"]) == 1) & _checks(c["k"]))
        told = F.transform(alone, lambda c: _places(c["k"], table, salt, c["k"].alias("k"), c["n"].alias("n")))
        one_more = F.struct(*(state[f"t{i}"].alias(f"t{i}") for i in _TABLES), state["found"].alias("found"), (state["idle"] + 1).alias("idle"))
        return F.aggregate(told, one_more, out)

    start = F.struct(*(F.slice(cells, table * i + 1, table).alias(f"t{i}") for i in _TABLES), _none().alias("found"), F.lit(0).alias("idle"))
    turns = F.flatten(F.array_repeat(F.array(*(F.lit(i) for i in _TABLES)), ROUNDS))
    clear = lambda c: (c["n"] == 0) & (c["k"] == 0)
    # when no table has had a single digest, none will
    one = lambda s, i: F.when(s["idle"] >= len(_TABLES), s).when(i == 0, turn(s, 0)).when(i == 1, turn(s, 1)).otherwise(turn(s, 2))
    end = lambda s: F.struct((F.forall(s["t0"], clear) & F.forall(s["t1"], clear) & F.forall(s["t2"], clear)).alias("ok"), s["found"].alias("found"))
    return F.aggregate(turns, start, one, end)


def _none() -> Column:
    return F.array().cast("array<struct<k: bigint, n: int>>")


def _told(cells: Column) -> Column:
    """Cells as a string: count and digests of each, nothing for an empty one."""
    one = lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws(".", c["n"].cast("string"), c["k"].cast("string")))
    return F.array_join(F.transform(cells, one), ",")


def _read(fingerprint: Column) -> Column:
    one = lambda x: F.when(x == "", _zero()).otherwise(_cell(F.split(x, r"\.")[0], F.split(x, r"\.")[1].cast("bigint")))
    return F.transform(F.split(fingerprint, ",", -1), one)


def _likeness(a: Column, b: Column, d: Column) -> Column:
    """Of a and b digests, d of which only one side has: the share of all that both have."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - d) / (a + b + d))


def compare_fingerprints(left: Column, right: Column) -> Column:
    """Of two fingerprint strings: likeness, only_left and only_right (digests); null if they are too small for the difference."""
    count = lambda cells: F.aggregate(F.slice(cells, 1, TABLE), F.lit(0), lambda n, c: n + c["n"])
    less = lambda l, r: _cell(l["n"] - r["n"], l["k"].bitwiseXOR(r["k"]))  # noqa: E731, E741

    def of(both: Column) -> Column:
        found = peeled(F.zip_with(both["l"], both["r"], less), *_first())
        side = lambda x, n: F.transform(F.filter(x["found"], lambda e: e["n"] == n), lambda e: e["k"])
        told = lambda x: F.struct(_likeness(count(both["l"]), count(both["r"]), F.size(x["found"])).alias("likeness"), side(x, 1).alias("only_left"), side(x, -1).alias("only_right"))
        return _let(found, lambda x: F.when(x["ok"], told(x)))

    return _let(F.struct(_read(left).alias("l"), _read(right).alias("r")), of)


def _place(k: Column, table: int, salt: int, size: Column) -> Column:
    return F.xxhash64(k, F.lit(3 * salt + table)).bitwiseAND(size - 1)


def _signed(lists: DataFrame, key: str, versions: list[str], salt: int) -> DataFrame:
    """key, v, s (cells in a table), t, i, n, k: the cells of the first version less those of version v, those that are left."""
    first = F.col(f"_p_{versions[0]}")
    marked = lambda p, v, n, s: F.transform(p, lambda d: F.struct(d.alias("k"), F.lit(v).alias("v"), F.lit(n).cast("bigint").alias("n"), s.alias("s")))
    parts = []
    for v, name in enumerate(versions[1:], 1):
        other = F.col(f"_p_{name}")
        need = F.greatest(F.lit(LEAST), (F.size(first) + F.size(other)) / LOAD)
        size = F.least(F.lit(MOST), F.shiftleft(F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("bigint"), salt))
        parts += [marked(first, v, 1, size), marked(other, v, -1, size)]
    one = lists.select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")
    cells = one.select(key, "v", "s", "n", "k", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), _place(F.col("k"), t, salt, F.col("s")).alias("i")) for t in _TABLES))).alias("c"))
    return _summed(cells.select(key, "v", "s", "c.t", "c.i", "n", "k"), key)


def _summed(cells: DataFrame, key: str) -> DataFrame:
    return cells.groupBy(key, "v", "s", "t", "i").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k")).filter("n <> 0 OR k <> 0")


def _turn(cells: DataFrame, key: str, table: int, salt: int, digests: bool) -> DataFrame:
    """The digests that are alone in a cell of a table taken out of all three; each goes to a row of its own (t 3), or to one that counts them."""
    n, k, s = F.col("n"), F.col("k"), F.col("s")
    cell = lambda t, i, n: F.struct(F.lit(t).alias("t") if isinstance(t, int) else t.alias("t"), i.alias("i"), n.alias("n"), k.alias("k"))
    own = cell(F.col("t"), F.col("i"), n)
    single = (F.col("t") == table) & (F.abs(n) == 1) & _checks(k)
    told = cell(3, k, n) if digests else cell(3, F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    out = F.when(single, F.array(own, *(cell(t, _place(k, t, salt, s), -n) for t in _TABLES), told)).otherwise(F.array(own))
    return _summed(cells.select(key, "v", "s", F.explode(out).alias("c")).select(key, "v", "s", "c.*"), key)


def _attempt(lists: DataFrame, key: str, versions: list[str], salt: int, digests: bool) -> DataFrame:
    """key, v, ok, d, and with digests left and right: what peeling finds for each row and version."""
    # a list is small and its cells are many, so partitions are set by the digests and not by the bytes that are shuffled
    size = lambda v: F.size(f"_p_{v}")
    total = lists.agg(*(F.sum(size(versions[0]) + size(v)) for v in versions[1:])).first()
    cells = _signed(lists.repartition(sum(x or 0 for x in total) // TASK_DIGESTS + 1, key), key, versions, salt)
    for _ in range(ROUNDS):
        for table in _TABLES:
            cells = _turn(cells, key, table, salt, digests)
    side = lambda n: F.collect_list(F.when((F.col("t") == 3) & (F.col("n") == n), F.col("k")))
    more = [side(1).alias("left"), side(-1).alias("right")] if digests else []
    return cells.groupBy(key, "v").agg(F.min(F.col("t") == 3).alias("ok"), F.coalesce(F.sum(F.when(F.col("t") == 3, F.lit(1) if digests else F.col("n"))), F.lit(0)).alias("d"), *more)


def compare(rows: DataFrame, key: str, versions: list[str], digests: bool = True) -> DataFrame:
    """rows without the columns of versions (texts), but with fingerprint_<v> of each and near_<v> of each but the first; with digests also
    only_first_<v> and only_<v>, the digests that only the first or only v has. key tells rows apart.
    """
    kept = [c for c in rows.columns if c not in versions]
    lists = [f"_p_{v}" for v in versions]
    base = staged(rows.select(*kept, *(F.array_distinct(paragraphs(F.col(v))).alias(p) for v, p in zip(versions, lists, strict=True))), "fingerprint-digests", "zstd")
    found = staged(_attempt(base.select(key, *lists), key, versions, 0, digests), "fingerprint-peeled", "zstd")
    done = found.filter("ok")
    for salt in range(1, RETRIES + 1):
        stuck = found.filter("NOT ok").select(key, "v")
        if stuck.isEmpty():
            break
        again = base.select(key, *lists).join(small(stuck.select(key).distinct()), key, "left_semi")
        found = staged(_attempt(again, key, versions, salt, digests).join(small(stuck), [key, "v"], "left_semi"), "fingerprint-peeled", "zstd")
        done = done.unionByName(found.filter("ok"))
    else:
        done = done.unionByName(found.filter("NOT ok"))
    one = lambda c, v: F.max(F.when(F.col("v") == v, F.col(c)))
    names = ["d", "ok", *(["left", "right"] if digests else [])]
    wide = done.groupBy(key).agg(*(one(c, v).alias(f"_{c}_{name}") for v, name in enumerate(versions[1:], 1) for c in names))
    both = base.join(wide, key, "left")
    none = F.array().cast("array<bigint>")
    size = lambda v: F.size(f"_p_{v}")
    first = versions[0]
    later = versions[1:]
    return both.select(
        *kept,
        *(_told(sketch(F.col(p), *_first())).alias(f"fingerprint_{v}") for v, p in zip(versions, lists, strict=True)),
        *(F.when(F.coalesce(f"_ok_{v}", F.lit(True)), _likeness(size(first), size(v), F.coalesce(f"_d_{v}", F.lit(0)))).alias(f"near_{v}") for v in later),
        *(F.coalesce(f"_left_{v}", none).alias(f"only_first_{v}") for v in later if digests),
        *(F.coalesce(f"_right_{v}", none).alias(f"only_{v}") for v in later if digests),
    )


def _groups(docs: DataFrame) -> Column:
    """A number for each run of about ROWS ids in order, -1 for none; ends are looked up in two steps, of as many ends each."""
    rows = docs.count()
    n = min(rows // ROWS + 1, GROUPS)
    if n == 1:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    ends = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    ends = sorted(set(ends))
    if not ends:
        return F.lit(-1)
    width = int(len(ends) ** 0.5) + 1
    runs = [ends[k : k + width] for k in range(0, len(ends), width)]
    longs = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("doc_id")))
    run = F.greatest(below(longs([r[0] for r in runs])), F.lit(1))
    inside = F.element_at(F.from_json(F.lit(str(runs)), "array<array<bigint>>"), run)
    return F.when(F.col("doc_id").isNull(), -1).otherwise((run - 1) * width + below(inside))


def with_next(docs: DataFrame) -> DataFrame:
    """group, number, doc_id, text, next: each row of docs (doc_id, text) with the text of the next row by descending doc_id; after the last, the first.

    Rows are dealt to runs of neighbouring ids; the first rows of a run go to the run before it too, where they stand last.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("group", _groups(own.select("doc_id")))
    heads = sorted(((r["group"], r["head"]) for r in own.groupBy("group").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    spark = docs.sparkSession
    # the first of a run is next to the last of the run above it, the first of all to the last of all
    to = [(g, head, heads[k - 1][0]) for k, (g, head) in enumerate(heads)]
    table = spark.createDataFrame(to, "group int, head bigint, to int")
    placed = own.join(F.broadcast(table), "group", "left").select(
        "doc_id", "text",
        F.explode(F.concat(F.array(F.struct(F.col("group"), F.lit(0).alias("guest"))), F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("to").alias("group"), F.lit(1).alias("guest")))).otherwise(F.array().cast("array<struct<group: int, guest: int>>")))).alias("p"),
    )
    order = Window.partitionBy("group").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    placed = placed.select(F.col("p.group").alias("group"), F.col("p.guest").alias("guest"), "doc_id", "text")
    return placed.select("group", F.row_number().over(order).alias("number"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next")).filter("guest = 0").drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of the start of the following, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """For each row of docs its fingerprint, that of its edited text, and how alike it is to that and to the next row's text."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next")))
    row = F.shiftleft(F.col("group").cast("bigint"), 32) + F.col("number")
    kept = rows.select(row.alias("row"), "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next")
    told = compare(kept, "row", ["text", "edited", "next"], digests=False)
    return told.select("doc_id", "n_chars", "edited_sha256", F.col("fingerprint_text").alias("fingerprint"), F.col("fingerprint_edited").alias("edited_fingerprint"), "near_edited", "near_next")
