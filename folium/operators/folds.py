"""Folds over the ordered rows of a key that no window expresses.

Spark shuffles by key and sorts; tasks read the rows as a stream and hold the state of one key, so a key of any length takes
linear time and bounded memory. Null is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of a batch that a task gives back.
BATCH = 8192


def over_keys(rows: DataFrame, key: str | list[str], order: list[str], take: list[Column], fields: list[StructField], each: Callable[[Iterator[tuple]], Iterable[tuple]], dealt: bool = False) -> DataFrame:
    """key (or the columns of one), fields: what `each` makes of the rows (take) of a key, in order.

    dealt: the rows of a key are in one partition and one after the other already, in order; nothing is shuffled or sorted then.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n = len(keys)
    names = [f"_t{k}" for k in range(len(take))]
    told = rows.withColumns(dict(zip(names, take, strict=True)))
    ordered = (told if dealt else told.repartition(*keys).sortWithinPartitions(*keys, *order)).select(*keys, *names)
    schema = StructType([*(StructField(k, rows.schema[k].dataType) for k in keys), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (row for b in batches for row in zip(_rows(b.columns[:n]), _rows(b.columns[n:]), strict=True))
        made = ((*k, *out) for k, group in groupby(told, key=itemgetter(0)) for out in each(map(itemgetter(1), group)))
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _rows(columns: list[pa.Array]) -> Iterator[tuple]:
    """The rows of columns as tuples. Whole columns of numbers become Python's at once."""
    number = lambda c: not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    return zip(*(c.to_numpy().tolist() if number(c) else c.to_pylist() for c in columns), strict=True)


def scanned(rows: DataFrame, key: str, order: list[str], take: list[Column], name: str, kind: str, start: Any, step: Callable[[Any, tuple], Any]) -> DataFrame:
    """rows with `name`: the state after each row of the key, in order, from `start` and `step(state, take)`; the other columns stay in Arrow."""
    names = [f"_t{k}" for k in range(len(take))]
    kept = [c for c in rows.columns if c != name]
    ordered = rows.withColumns({"_key": F.col(key)} | dict(zip(names, take, strict=True))).repartition("_key").sortWithinPartitions("_key", *order).select("_key", *names, *kept)
    schema = StructType([*(rows.schema[c] for c in kept), StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = start, None, False
        for b in batches:
            states = []
            for k, *values in zip(*(b.column(i).to_pylist() for i in range(len(names) + 1)), strict=True):
                if not begun or k != last:
                    state, last, begun = start, k, True
                state = step(state, tuple(values))
                states.append(state)
            yield pa.RecordBatch.from_arrays([*(b.column(i + len(names) + 1).cast(arrow.field(i).type) for i in range(len(kept))), pa.array(states, type=arrow.field(len(kept)).type)], schema=arrow)

    return ordered.mapInArrow(run, schema)
