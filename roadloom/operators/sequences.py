"""Ordered per-entity kernels over bounded groups.

An entity's sequence is cut into blocks of time, so that a hot entity is spread over tasks; kernels see whole groups,
sorted, many at a time, as Arrow tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.session import kernel_partitions

#: Rows that a kernel is given at once, unless one group is longer.
CHUNK = 100_000
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Index of the first row of each group in a table sorted by keys (equal nulls belong together)."""
    n = t.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        if n > 1:
            c = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spans(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """First and next row of each group of n rows, `starts` being the groups' first rows; no rows have no groups."""
    first = [int(a) for a in starts]
    return list(zip(first, [*first[1:], n], strict=True)) if first else []


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Runs fn(table of whole groups sorted by order, first row of each group) over df grouped by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            starts = changes(t, keys)
            cut = t.num_rows if last else int(starts[-1])
            if cut:
                yield from fn(t.slice(0, cut), starts[starts < cut]).to_batches()
            held = t.slice(cut).combine_chunks().to_batches() if cut < t.num_rows else []
            rows = t.num_rows - cut

        limit = CHUNK
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= limit:
                    yield from flush(False)
                    limit = max(CHUNK, 2 * rows)
        if rows:
            yield from flush(True)

    return df.repartition(kernel_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def with_halo(df: DataFrame, t: str, block_us: int, halo_us: int) -> DataFrame:
    """Adds `block` (of time t in µs); a row within halo_us of another block also comes in that one."""
    at = lambda d: F.floor((F.col(t) + F.lit(d)) / F.lit(block_us)).cast("int")
    return df.withColumn("block", F.explode(F.array_distinct(F.array(at(0), at(-halo_us), at(halo_us)))))


def natural_groups(rows: DataFrame, entity: str, block: str = "block", head: str = "head") -> DataFrame:
    """Replaces block and head by `group`: a block's rows from its first cut on are a group, and its head rows (before
    that cut) belong to the group of the last block of the entity that has a cut.

    The blocks' summary has a row per entity and block; only head rows meet it in the join.
    """
    held = rows.groupBy(entity, block).agg((~F.min(head)).alias("has_cut"))
    before = W.partitionBy(entity).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("has_cut"), F.col(block)), True).over(before), F.lit(-(2**31)))
    held = held.select(F.col(entity).alias("__e"), F.col(block).alias("__b"), last.alias("__g"))
    joined = rows.join(held, (F.col(entity) == F.col("__e")) & (F.col(block) == F.col("__b")) & F.col(head), "left")
    return joined.withColumn("group", F.coalesce("__g", block)).drop("__e", "__b", "__g", block, head)
