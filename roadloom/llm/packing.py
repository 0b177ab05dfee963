"""Items of varying length combined into containers of fixed capacity with little unused space.

Planned on the histogram of sizes, which has at most `capacity` bins whatever the number of items: combinations of few
sizes that fill a window at the capacity are enumerated, their repeat counts come from non-negative least squares
against the histogram, are rounded down, and what remains is packed greedily, best fit in descending size, into the
space left and into new containers. Items then find their place by their rank within their size.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.llm.tokens import VOCABULARY, token_counts
from roadloom.session import written

CAPACITY = 4096
#: Size classes of the least squares, the most items of a combination, the space that a container planned by them may
#: leave unused, and buckets that the items of one size are ranked in.
CLASSES, DEPTH, UNUSED, BUCKETS = 64, 5, 8, 256


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of up to depth classes (1..classes, descending) that fill a window at the capacity.

    An item of class k is between k - 1 and k in size, k - 1/2 on average; so m of them fill the capacity if their
    classes add up to classes .. classes + m // 2.
    """
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], total: int, top: int) -> None:
        m = len(head)
        if m and classes <= total <= classes + m // 2:
            out.append(head)
        if m < depth:
            for k in range(min(top, classes + depth // 2 - total), 0, -1):
                if total + k * (depth - m) >= classes:
                    grow((*head, k), total + k, k)

    grow((), 0, classes)
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets (Lawson and Hanson). Ending before that, after `rounds` (three
    a column unless given), is reported; the x so far still plans whole containers."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[1] if rounds is None else rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = 0
        k = int(slope.argmax())
        if slope[k] <= small:
            break
        active.append(k)
        while active:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            now = x[active]
            down = z <= 0
            step = float((now[down] / np.maximum(now[down] - z[down], 1e-300)).min())
            now = now + step * (z - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = [i for i in active if x[i] > 1e-12]
            x[[i for i in range(len(x)) if x[i] <= 1e-12]] = 0
    else:
        warnings.warn("least squares ended before the least was reached", RuntimeWarning, stacklevel=2)
    return x


def _take(have: dict[int, int], sizes: list[int], count: int, largest: bool) -> list[list[int]]:
    """Removes count items of the given sizes from the histogram, from one end: runs [size, count]."""
    out = []
    for s in sorted(sizes, reverse=largest):
        n = min(have.get(s, 0), count)
        if n:
            out.append([s, n])
            have[s] -= n
            count -= n
        if not count:
            break
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH, unused: int = UNUSED) -> list[tuple[tuple[int, ...], int]]:
    """Containers for a histogram of sizes (1..capacity): (sizes in the container, number of such containers).

    Of the containers that least squares plans, those that the real sizes leave too empty are dissolved again.
    """
    have = {int(s): int(n) for s, n in histogram.items() if n > 0}
    if any(not 1 <= s <= capacity for s in have):
        raise ValueError("sizes must be between 1 and the capacity")
    width = capacity / classes
    members: dict[int, list[int]] = defaultdict(list)
    for s in have:
        members[int(np.ceil(s / width))].append(s)
    b = np.array([sum(have[s] for s in members[k]) for k in range(1, classes + 1)], float)
    there = b > 0
    combos = [c for c in combinations(classes, depth) if all(there[k - 1] for k in c)]
    filled: Counter[tuple[int, ...]] = Counter()
    if combos:
        a = np.zeros((classes, len(combos)))
        for j, c in enumerate(combos):
            for k in c:
                a[k - 1, j] += 1
        weight = 1 / np.sqrt(np.maximum(b, 1))  # so that rare sizes count too
        x = least_squares(a * weight[:, None], b * weight)
        for j in sorted(np.flatnonzero(x >= 1), key=lambda j: (-x[j], combos[j])):
            c = combos[j]
            need = Counter(c)
            count = min(int(x[j]), *(sum(have[s] for s in members[k]) // n for k, n in need.items()))
            if count < 1:
                continue
            # one slot takes its items from the largest down, the next from the smallest up: totals even out
            slots = [_take(have, members[k], count, i % 2 == 0) for i, k in enumerate(c)]
            while slots[0]:
                n = min(slot[0][1] for slot in slots)
                sizes = sorted((slot[0][0] for slot in slots), reverse=True)
                while sum(sizes) > capacity:  # beyond the capacity: its smallest goes back
                    have[sizes[-1]] += n
                    sizes.pop()
                if capacity - sum(sizes) <= unused:
                    filled[tuple(sizes)] += n
                else:
                    for s in sizes:
                        have[s] += n
                for slot in slots:
                    slot[0][1] -= n
                    if not slot[0][1]:
                        slot.pop(0)
    room: dict[int, Counter] = defaultdict(Counter)
    for sizes, n in filled.items():
        room[capacity - sum(sizes)][sizes] += n
    free = sorted(room)
    for s in sorted((s for s in have if have[s]), reverse=True):
        left = have[s]
        while left:
            i = bisect_left(free, s)
            if i == len(free):
                each = capacity // s
                for sizes, n in (((s,) * each, left // each), ((s,) * (left % each), 1)):
                    if n and sizes:
                        space = capacity - sum(sizes)
                        if space not in room or not room[space]:
                            insort(free, space)
                        room[space][sizes] += n
                break
            space = free[i]
            sizes, n = next(iter(room[space].items()))
            n = min(n, left)
            room[space][sizes] -= n
            if not room[space][sizes]:
                del room[space][sizes]
            if not room[space]:
                free.pop(i)
            rest = space - s
            if rest not in room or not room[rest]:
                insort(free, rest)
            room[rest][(*sizes, s)] += n
            left -= n
    return sorted((sizes, n) for group in room.values() for sizes, n in group.items() if n)


def placement(containers: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the item of each size and rank goes: rows (size, first rank, first container, offset), sorted."""
    rows, taken, first = [], Counter(), 0
    for sizes, n in containers:
        offset = 0
        for s in sizes:
            rows.append((s, taken[s], first, offset))
            taken[s] += n
            offset += s
        first += n
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("size", "rank", "container", "offset"), zip(*rows, strict=True) if rows else [[]] * 4, strict=True)}


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, size, container, start): each item's container and place in it.

    Only an item over the capacity is split, into full containers and a rest. An item of size 0 or null takes no
    space and has container null. The driver sees the histogram (at most `capacity` rows) and the plan; items of one
    size are ranked in buckets, so no size is gathered in one task, even if it holds a third of all items.
    """
    whole = F.col(size) / F.lit(capacity)
    items = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(whole).cast("int") - 1, F.lit(0)))))
    items = items.withColumn(size, F.least(F.lit(capacity).cast("bigint"), F.col(size) - F.col("piece") * capacity))
    items = items.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(BUCKETS)).cast("int"))
    counts = items.groupBy(size, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(size).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(size).alias("__s"), F.col("bucket").alias("__b"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("__s").agg(F.sum("n")).where("__s > 0").collect()}
    at = placement(plan(histogram, capacity))
    rank = F.row_number().over(W.partitionBy(size, "bucket").orderBy(key, "piece")) - 1
    ranked = items.withColumn("rank", rank).join(counts, (F.col(size) == F.col("__s")) & (F.col("bucket") == F.col("__b"))).select(key, "piece", size, (F.col("rank") + F.col("before")).alias("rank"))
    where = at["size"] * (1 << 40) + at["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, r = b.column(size).to_numpy(), b.column("rank").to_numpy()
            none = s == 0
            i = np.maximum(np.searchsorted(where, s * (1 << 40) + r, side="right") - 1, 0)
            if len(where):
                container, start = at["container"][i] + r - at["rank"][i], at["offset"][i]
            else:
                container = start = np.zeros(len(s), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("piece"), b.column(size), pa.array(container, mask=none), pa.array(start, mask=none)], [key, "piece", size, "container", "start"])

    kind = ranked.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"{key} {kind}, piece int, {size} bigint, container bigint, start bigint")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """packed() of documents by their tokens, counted once and kept in a table of the shared folder."""
    return packed(written(token_counts(docs.select("doc_id", "text"), path=vocabulary), "token-counts"), capacity=capacity)


def unused_space(assigned: DataFrame, capacity: int = CAPACITY, size: str = "n_tokens") -> DataFrame:
    """(containers, items, used, capacity, unused_share): containers summed up first, so the totals need no key."""
    per = assigned.where("container is not null").groupBy("container").agg(F.sum(size).alias("used"), F.count(F.lit(1)).alias("items"))
    total: Column = F.count(F.lit(1)) * capacity
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), total.alias("capacity"), (1 - F.try_divide(F.sum("used"), total)).alias("unused_share"), F.max("used").alias("fullest"))
