"""Greedy bins in order, range by range: no task holds or folds all rows of a group.

A bin closes before it would exceed the limit, so where each bin starts depends on the one
before.  Within a range of the order, what a bin carried in can change is only where the first
new bin starts; a range is summed up as a step function of the room that is left.
These functions, one row a range, are applied one after the other, and each range is then
placed by itself.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.writers import work_path

#: Rows of a range (sizes and keys only), which one task holds.
RANGE_ROWS = 500_000


def whole_ranges(batches):
    """One table for each __p of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for rb in batches:
        p = rb.column("__p").to_numpy()
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and p[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = p[lo]
            held.append(rb.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(t: pa.Table, group_cols: list[str]) -> np.ndarray:
    """Rows at which a group begins; equal groups lie together, null is a value."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for c in group_cols:
        codes = pc.dictionary_encode(t.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def next_starts(total: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For a bin that starts at each row, the row at which the next one starts."""
    n = len(total)
    before = np.concatenate(([0], total[:-1]))
    ends = np.append(starts[1:], n)[np.searchsorted(starts, np.arange(n), "right") - 1]
    return np.minimum(np.maximum(np.searchsorted(total, before + limit, "right"), np.arange(n) + 1), ends)


def bounds_of(total: np.ndarray, following: np.ndarray, limit: int):
    """(bounds, more, used) of a range that is all one group.

    With `room` left in the bin that comes in, the first bound above room tells how many bins
    begin in the range and how much the last one holds; beyond all bounds none begins.
    At most as many bounds as sizes fit within the limit, far fewer once chains have met.
    """
    n, nxt = len(total), following.tolist()
    last, hops = list(range(n)), [1] * n
    for j in range(n - 1, -1, -1):
        if nxt[j] < n:
            last[j], hops[j] = last[nxt[j]], hops[nxt[j]] + 1
    bounds: list[int] = []
    more: list[int] = []
    used: list[int] = []
    for j in range(int(np.searchsorted(total, limit, "right")) + 1):
        if j == n or (j and total[j] == total[j - 1]):
            continue
        k = last[j]
        filled = int(total[-1] - (total[k - 1] if k else 0))
        if bounds and (more[-1], used[-1]) == (hops[j], filled):
            bounds[-1] = int(total[j])
        else:
            bounds.append(int(total[j])), more.append(hops[j]), used.append(filled)
    return bounds, more, used


def range_facts(group_cols: list[str], size_col: str, limit: int, schema: pa.Schema):
    """Batches of rows to one row a range: its first and last group, the state it leaves, its bounds."""

    def run(batches):
        for t in whole_ranges(batches):
            starts = group_starts(t, group_cols)
            total = np.cumsum(t.column(size_col).to_numpy())
            following = next_starts(total, starts, limit)
            at, n_bins = int(starts[-1]), 0
            while following[at] < len(total):
                at, n_bins = int(following[at]), n_bins + 1
            key = lambda i: {c: t.column(c)[i].as_py() for c in group_cols}  # noqa: B023, E731
            bounds, more, used = bounds_of(total, following, limit) if len(starts) == 1 else ([], [], [])
            row = {"__p": t.column("__p")[0].as_py(), "lo": key(0), "hi": key(t.num_rows - 1), "one": len(starts) == 1, "bin": n_bins, "used": int(total[-1] - (total[at - 1] if at else 0)), "all": int(total[-1]), "bounds": bounds, "more": more, "filled": used}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def carried_states(limit: int, schema: pa.Schema):
    """Ranges in order to the bin and its contents that a range goes on with, where it goes on with one."""

    def run(batches):
        group = number = used = None
        for rb in batches:
            out = []
            for r in rb.to_pylist():
                goes_on = group is not None and group == repr(r["lo"])
                if goes_on:
                    out.append({"__p": r["__p"], "__bin": number, "__used": used})
                if goes_on and r["one"]:
                    i = bisect_right(r["bounds"], limit - used)
                    number, used = (number + r["more"][i], r["filled"][i]) if i < len(r["bounds"]) else (number, used + r["all"])
                else:
                    number, used = r["bin"], r["used"]
                group = repr(r["hi"])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def placed_rows(group_cols: list[str], size_col: str, limit: int):
    """Batches of rows, beside the state carried into their range, to the same rows with their bin."""

    def run(batches):
        for t in whole_ranges(batches):
            starts = group_starts(t, group_cols)
            total = np.cumsum(t.column(size_col).to_numpy())
            nxt, n = next_starts(total, starts, limit).tolist(), len(total)
            begins = np.zeros(n, dtype=np.int64)
            number, used = t.column("__bin")[0].as_py(), t.column("__used")[0].as_py()
            j = 0
            if number is not None:
                # the bin that comes in ends with its group at the latest
                j = min(int(np.searchsorted(total, limit - used, "right")), int(np.append(starts, n)[1]))
            while j < n:
                begins[j] = 1
                j = nxt[j]
            count = np.cumsum(begins)
            # a group's first bin is 0, one that comes in keeps its number
            base = count[starts].copy()
            if number is not None:
                base[0] = -number
            bins = count - base[np.searchsorted(starts, np.arange(n), "right") - 1]
            yield from t.drop_columns(["__bin", "__used"]).append_column("bin", pa.array(bins, pa.int64())).to_batches()

    return run


def greedy_bins(df: DataFrame, group_cols: list[str], order_cols: list[str], size_col: str, limit: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row with `bin` (long, from 0 in each group): in order, a bin closes before it would exceed limit.

    Rows of `size_col` (no nulls, none negative) that exceed the limit by themselves have a bin
    each.  Null is a group and an order like any other; rows equal in all order columns may change
    places.  Ranges are of about `range_rows` rows however large a group is; order columns should
    tell rows apart where very many share a place.
    """
    groups = group_cols or ["__all"]
    d = (df if group_cols else df.withColumn("__all", F.lit(0))).withColumn(size_col, F.col(size_col).cast("long"))
    n = max(1, math.ceil(d.count() / range_rows))
    long = T.LongType()
    in_order = lambda x: x.repartition(n, "__p").sortWithinPartitions("__p", *groups, *order_cols)
    if n == 1:
        rows = d.withColumn("__p", F.lit(0))
        beside = rows.withColumns({"__bin": F.lit(None).cast(long), "__used": F.lit(None).cast(long)})
    else:
        # written out: the range numbers must be the same for facts and places
        path = work_path(df, "bins")
        d.repartitionByRange(n, *groups, *order_cols).withColumn("__p", F.spark_partition_id()).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        key, longs = T.StructType([rows.schema[c] for c in groups]), T.ArrayType(long)
        facts = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("lo", key), T.StructField("hi", key), T.StructField("one", T.BooleanType()), *[T.StructField(c, long) for c in ("bin", "used", "all")], *[T.StructField(c, longs) for c in ("bounds", "more", "filled")]])
        states = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__bin", long), T.StructField("__used", long)])
        found = in_order(rows.select("__p", *groups, *[c for c in order_cols if c not in groups and c != size_col], size_col)).mapInArrow(range_facts(groups, size_col, limit, to_arrow_schema(facts)), facts)
        carried = found.repartition(1).sortWithinPartitions("__p").mapInArrow(carried_states(limit, to_arrow_schema(states)), states)
        beside = rows.join(F.broadcast(carried.withColumnRenamed("__p", "p2")), F.col("__p") == F.col("p2"), "left").drop("p2")  # at most one row a range
    out = T.StructType([*rows.schema.fields, T.StructField("bin", long)])
    return in_order(beside).mapInArrow(placed_rows(groups, size_col, limit), out).drop("__p", "__all")
