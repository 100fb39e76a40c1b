"""Rows that depend on the rows before them, key by key, in order.

Rows are dealt by key, sorted, and read as a stream of batches with one state
object per key: memory holds the state, never a key's rows.

In ``scan`` a key is one task: its state may depend on every decision before.
Where a few of a key's last rows tell all of its state, ``spread_scan`` deals a
hot key over many tasks by ranges of its order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.storage import materialize


def scan(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Any], name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name``: ``step(state, row)`` of each row; the state starts anew for each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    now, state = k, start()
                out.append(step(state, row))
            yield b.assign(**{name: pd.Series(out, index=b.index)})

    schema = StructType.fromJson(df.schema.jsonValue()).add(name, kind)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def spread_scan(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Any], keep: Callable[[], Any], name: str, kind: str) -> DataFrame:
    """``scan`` for states that a few rows rebuild, with a key's rows in as many tasks as they fill.

    ``keep()`` makes a holder with ``add(row)`` and ``rows()``: those of the rows
    added, in order, whose steps from a new state give the state that all gave.
    What reaches the driver is one holder's rows for each partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).withColumn("part_", F.spark_partition_id())
    rows = materialize(dealt, "ranges").repartition(n, "part_").sortWithinPartitions("part_", key, *order)
    names = df.columns

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, held = None, None, None

        def out() -> pd.DataFrame:
            got = held.rows()
            return pd.DataFrame({c: pd.Series([getattr(r, c) for r in got], dtype=types[c]) for c in names}).assign(part_=pd.Series([part] * len(got), dtype="int32"))

        for b in batches:
            types = b.dtypes
            for row in b.itertuples(index=False):
                if row.part_ != part and held is not None:
                    yield out()
                if row.part_ != part or getattr(row, key) != now:
                    part, now, held = row.part_, getattr(row, key), keep()
                held.add(row)
        if held is not None:
            yield out()

    last = spark.sparkContext.broadcast(sorted(rows.mapInPandas(ends, rows.schema).collect(), key=lambda r: (r["part_"], *[r[c] for c in order])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, state = None, None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if row.part_ != part or k != now:
                    state = start()
                    if row.part_ != part:  # the first key of a range may go on from the ranges before
                        for r in last.value:
                            if r["part_"] < row.part_ and r[key] == k:
                                step(state, r)
                    part, now = row.part_, k
                out.append(step(state, row))
            yield b.drop(columns="part_").assign(**{name: pd.Series(out, index=b.index)})

    return rows.mapInPandas(run, StructType.fromJson(df.schema.jsonValue()).add(name, kind))
