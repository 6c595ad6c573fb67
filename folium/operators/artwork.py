"""Pictures and formulas of pages: tiles and strokes that form one picture, artwork without a caption, lines of numbered equations.

Boxes are x0, y0, x1, y1 on a page (doc_id, page). What can touch is found by the cells of a grid that boxes cover, so that only near boxes meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import product
from math import isfinite, isnan
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folium.sources.tables import settled  # noqa: F401  (a test holds that nothing here keeps rows)

from .folds import over_keys

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]
#: Side of the cells of the grid.
CELL = 64.0


def clusters(boxes: DataFrame, pad: float = 3.0) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1, segments: boxes (with a number of segments) joined while any two lie nearer than `pad`.

    A joined box is the smallest around its parts and takes in what it comes to touch. In which order boxes are joined does not matter, so they are
    shuffled by their page once, and tasks read them as a stream with the joined boxes of one page. What has no place on a page stays alone.
    """
    kinds = [*(StructField(c, boxes.schema[c].dataType) for c in BOX), *boxes.select(F.sum("segments").alias("segments")).schema.fields]
    told = reduce(Column.__and__, [*(F.col(c).isNotNull() for c in PAGE), *(F.abs(F.col(c)) < float("inf") for c in BOX)])

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        alone: list[tuple] = []
        yield from _joined((r[1:] if r[0] else alone.append(r[1:]) for r in rows), pad)
        yield from alone

    return over_keys(boxes, PAGE, [], [told, *(F.col(c) for c in (*BOX, "segments"))], kinds, each)


def _joined(boxes: Iterable[tuple | None], pad: float) -> list[tuple]:
    """Boxes (x0, y0, x1, y1, segments) of a page, joined; each new one meets those under the cells of the grid that it covers."""
    held: dict[int, list] = {}
    under: dict[tuple, set[int]] = {}
    for n, box in enumerate(boxes):
        if box is None:
            continue
        x0, y0, x1, y1, segments = box
        while True:
            near = {i for g in _cover(x0 - pad, y0 - pad, x1 + pad, y1 + pad) for i in under.get(g, ()) if _touch(held[i], x0, y0, x1, y1, pad)}
            if len(near) == 1:
                own = held[next(iter(near))]
                if own[0] <= x0 and own[1] <= y0 and x1 <= own[2] and y1 <= own[3]:
                    own[4] = _added(own[4], segments)
                    break
            if not near:
                held[n] = [x0, y0, x1, y1, segments]
                for g in _cover(x0, y0, x1, y1):
                    under.setdefault(g, set()).add(n)
                break
            for i in near:
                own = held.pop(i)
                for g in _cover(*own[:4]):
                    under[g].discard(i)
                x0, y0, x1, y1 = min(x0, own[0]), min(y0, own[1]), max(x1, own[2]), max(y1, own[3])
                segments = _added(own[4], segments)
    return [tuple(b) for b in held.values()]


def _cover(x0: float, y0: float, x1: float, y1: float) -> Iterator[tuple]:
    """The grid cells that a box covers, whichever of its corners comes first."""
    xs, ys = sorted((int(x0 // CELL), int(x1 // CELL))), sorted((int(y0 // CELL), int(y1 // CELL)))
    return product(range(xs[0], xs[1] + 1), range(ys[0], ys[1] + 1))


def _touch(b: list, x0: float, y0: float, x1: float, y1: float, pad: float) -> bool:
    """Whether either reaches the other within pad."""
    return x0 - pad < b[2] and b[0] < x1 + pad and y0 - pad < b[3] and b[1] < y1 + pad


def _added(a: float | None, b: float | None) -> float | None:
    return a if b is None else b if a is None else a + b


def standalone(pictures: DataFrame, strokes: DataFrame, taken: DataFrame, prose: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, x0, y0, x1, y1 of artwork that no caption names, the largest first where two claim a place.

    pictures: boxes; strokes: boxes with segments; taken: boxes of what has been used; prose: boxes of paragraphs with chars and block; pages: doc_id, page, width,
    height. Artwork is 24 by 24 and 900 in area at least; strokes have three segments or more, cover less than three quarters of the page
    and lie under no paragraph of over 55 characters. What a page consists of is shuffled once, and tasks read it as a stream with the boxes of one page.
    """
    told = reduce(Column.__and__, [*(F.col(c).isNotNull() for c in PAGE), *(F.abs(F.col(c)) < float("inf") for c in BOX)])
    none = F.lit(None)

    def part(kind: int, df: DataFrame, n: Column = none, block: Column = none) -> DataFrame:
        return df.select(*PAGE, F.lit(kind).alias("kind"), *(F.col(c).cast("double").alias(c) for c in BOX), n.cast("double").alias("n"), block.cast("string").alias("block")).filter(told)

    wider = strokes.select(*PAGE, *((F.col(c) + d).alias(c) for c, d in zip(BOX, (-0.5, -0.5, 0.5, 0.5), strict=True)), "segments").filter((F.col("segments") > 0) & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > 20))
    # nothing is cut off at a side that is not known
    side = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1e300))
    sizes = pages.select(*PAGE, F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), side("width").alias("x1"), side("height").alias("y1"), (F.col("width") * F.col("height")).alias("size"))
    parts = [part(_PAGES, sizes, F.col("size")), part(_TAKEN, taken), part(_PICTURES, pictures), part(_STROKES, wider, F.col("segments")), part(_TEXTS, prose, F.col("chars"), F.col("block"))]
    rows = reduce(DataFrame.unionByName, parts)
    return over_keys(rows, PAGE, ["kind"], [F.col(c) for c in ("kind", *BOX, "n", "block")], [StructField(c, DoubleType()) for c in BOX], _page_artwork)


#: What the rows of a page are.
_PAGES, _TAKEN, _PICTURES, _STROKES, _TEXTS = range(5)
#: Of a box, what another must hold of it to count as its holder.
HELD = 0.55


class _Holders:
    """Boxes of a page by the cells of the grid that they cover, asked which of them hold more than HELD of a box."""

    def __init__(self, boxes: Iterable[tuple] = ()):
        self.under: dict[tuple, list[tuple]] = {}
        for n, b in enumerate(boxes):
            self.add(n, b)

    def add(self, n: int, box: tuple) -> None:
        for g in _cover(*box):
            self.under.setdefault(g, []).append((n, box))

    def of(self, x0: float, y0: float, x1: float, y1: float, least: float | None = None) -> list[int]:
        # what holds more than half of a box holds its middle
        near = self.under.get((int((x0 + x1) / 2 // CELL), int((y0 + y1) / 2 // CELL)), ())
        least = HELD * (x1 - x0) * (y1 - y0) if least is None else least
        return [n for n, b in near if (w := min(x1, b[2]) - max(x0, b[0])) > 0 and (h := min(y1, b[3]) - max(y0, b[1])) > 0 and w * h > least]


def _large(x0: float, y0: float, x1: float, y1: float) -> bool:
    return x1 - x0 >= 24 and y1 - y0 >= 24 and (x1 - x0) * (y1 - y0) >= 900


def _page_artwork(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Artwork of one page, from its rows (kind, x0, y0, x1, y1, n, block)."""
    of: dict[int, list[tuple]] = {}
    for kind, *row in rows:
        of.setdefault(kind, []).append(tuple(row))
    sizes = [r[2:5] for r in of.get(_PAGES, ())]
    if not sizes:
        return
    used = _Holders(r[:4] for r in of.get(_TAKEN, ()))
    joined = lambda kind: _joined((r[:5] for r in of.get(kind, ()) if not used.of(*r[:4])), 3.0)
    most = 0.75 * max((n for *_, n in sizes if n is not None), default=0.0)
    drawn = [b for *b, n in joined(_STROKES) if n >= 3 and _large(*b) and (b[2] - b[0]) * (b[3] - b[1]) < most]
    shade, chars = _Holders(drawn), {}
    for *box, n, block in of.get(_TEXTS, ()):
        for i in shade.of(*box):
            chars[i, block] = chars.get((i, block), 0) + (n or 0)
    hidden = {i for (i, _), n in chars.items() if n > 55}
    found = [b for *b, _ in joined(_PICTURES) if _large(*b)] + [b for i, b in enumerate(drawn) if i not in hidden]
    shown = ((-(x1 - x0) * (y1 - y0), max(y0, 0.0), max(x0, 0.0), min(y1, high), min(x1, wide)) for x0, y0, x1, y1 in found for wide, high, _ in sizes)
    kept = _Holders()
    # from the largest on, those that no kept one holds
    for _, y0, x0, y1, x1 in sorted(b for b in shown if b[4] > b[2] and b[3] > b[1]):
        if not used.of(x0, y0, x1, y1) and not kept.of(x0, y0, x1, y1, HELD * ((x1 - x0) * (y1 - y0))):
            kept.add(0, (x0, y0, x1, y1))
            yield x0, y0, x1, y1


#: Lines that are prose rather than parts of a formula.
_PROSE = (r":$", r"[a-zA-Z]{3}", r"[A-Za-z]{3,}", r"^[A-Za-z][a-z]{2,}\s", r"[A-Za-z]{2,}")


def is_prose(text: Column, heading: Column) -> Column:
    """A lead-in that ends in a colon, four longer words, a sentence that starts with a word and has three, or a heading."""
    many = lambda p, n: F.regexp_count(text, F.lit(p)) >= n
    return (text.rlike(_PROSE[0]) & text.rlike(_PROSE[1])) | many(_PROSE[2], 4) | (text.rlike(_PROSE[3]) & many(_PROSE[4], 3)) | heading


def equations(lines: DataFrame, pages: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """doc_id, page, n, text, x0, y0, x1, y1: lines around each number in brackets at the right margin.

    lines: doc_id, page, x0, y0, x1, y1, text, heading; pages: doc_id, page, width, two_columns, or columns that the lines have themselves. An equation
    reaches 30 up and down from its number, at most to the next prose line and half way to the next number; lines are taken in the order of their heights.
    What a page consists of is shuffled once, and tasks read it as a stream with the lines of one page; nothing is if lines of a page are together (dealt).
    """
    prose, number = is_prose(F.col("text"), F.col("heading")), F.regexp_extract("text", r"\((\d+)\)$", 1)
    size = lambda known: [F.col(c).cast(t) if known else F.lit(None).cast(t) for c, t in (("width", "double"), ("two_columns", "boolean"))]
    take = [*(F.col(c).cast("double") for c in BOX), F.when(~prose, F.col("text")), prose, F.when((number != "") & ~prose, number)]
    names = ["kind", "width", "two_columns", *BOX, "text", "prose", "n"]
    part = lambda df, *columns: df.select(*PAGE, *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    rows = part(lines, F.lit(1), *size(pages is None), *take)
    if pages is not None:
        rows = rows.unionByName(part(pages, F.lit(0), *size(True), *(F.lit(None) for _ in take))).dropna(subset=PAGE)
    fields = [*StructType.fromDDL("n string, text string").fields, *(StructField(c, DoubleType()) for c in BOX)]
    found = over_keys(rows, PAGE, ["kind"], [F.col(c) for c in names], fields, _page_equations, dealt and pages is None)
    return found.select(*PAGE, "n", "text", *(F.col(c).cast(lines.schema[c].dataType).alias(c) for c in BOX))


def _page_equations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """n, text and box of the equations of a page, from its rows (kind, width, two_columns, x0, y0, x1, y1, text, prose, n): its sizes first, if these are told."""
    sizes: list[tuple] = []
    lines: list[tuple] = []
    for kind, width, two, *line in rows:
        if kind == 0:
            sizes.append((width, two))
        else:
            lines.append((width, two, *line))
    if not sizes:
        yield from _numbered(n for n in lines if n[0] is not None)
    else:
        yield from _numbered((*size, *n[2:]) for size in sizes for n in lines)


def _numbered(lines: Iterable[tuple]) -> Iterator[tuple]:
    columns: tuple[tuple, ...] = tuple(([], [], [], []) for _ in range(2))
    for width, two, x0, y0, x1, y1, text, prose, n in lines:
        ends, starts, numbers, parts = columns[bool(two and width is not None and x0 is not None and not x0 < width / 2)]
        if prose:
            ends += [] if y1 is None or isnan(y1) else [y1]
            starts += [] if y0 is None or isnan(y0) else [y0]
        elif prose is not None and y0 is not None and y1 is not None and isfinite(mid := (y0 + y1) / 2):
            parts.append((mid, y0, (x0 is not None, x0 is not None and isnan(x0), x0), text, x1, y1))
            if n is not None:
                edge = None if width is None else width / 2 - 10 if two and x1 is not None and x1 < width / 2 + 8 else width * 0.91
                numbers.append((mid, n, edge is not None and x1 is not None and not x1 <= edge - 18))
    for ends, starts, numbers, parts in columns:
        ends.sort()
        starts.sort()
        parts.sort(key=itemgetter(0))
        mids, at = sorted({m for m, *_ in numbers}), [p[0] for p in parts]
        for mid, n, right in numbers:
            if not right:
                continue
            i, over, under = bisect_left(mids, mid), bisect_left(ends, mid), bisect_right(starts, mid)
            # other numbers at the same height are neither above nor below
            low = max([mid - 30, *ends[max(over - 1, 0) : over], *((m + mid) / 2 for m in mids[max(i - 1, 0) : i])])
            high = min([mid + 30, *starts[under : under + 1], *((m + mid) / 2 for m in mids[i + 1 : i + 2])])
            own = sorted(parts[bisect_right(at, low) : bisect_left(at, high)], key=itemgetter(1, 2, 3))
            if own:
                lefts, rights = [p[2][2] for p in own if p[2][0]], [p[4] for p in own if p[4] is not None]
                x0 = min((x for x in lefts if not isnan(x)), default=lefts[0] if lefts else None)
                x1 = next((x for x in rights if isnan(x)), max(rights, default=None))
                yield n, " ".join(p[3] for p in own), x0, min(p[1] for p in own), x1, max(p[5] for p in own)
