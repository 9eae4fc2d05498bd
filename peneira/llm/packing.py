"""Filling containers of permitted capacities with whole items (p8).

The sizes of all items make a histogram with at most as many lines as the
largest capacity, whatever the corpus. Variable-capacity best-fit runs on the
histogram: sizes from large to small, each into the tightest open containers
that take it, new containers of the size that costs least for what it can be
filled with from all that is left; at the end each
container shrinks to the least permitted capacity that holds its contents. The
plan says which ranks of which size go to which containers; the items, ranked
within their size by distributed counts, look their container up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.session import staged

# Cost of a container beside its capacity, in tokens.
OVERHEAD = 64


def _fill(space: int, ordered: list[int], left: dict[int, int]) -> int:
    """Tokens that the items left, size -> number, can put into a space: the largest that fits first, and again."""
    filled, top = 0, len(ordered)
    while space and top:
        top = bisect_right(ordered, space, 0, top)
        if not top:
            break
        size = ordered[top - 1]
        each = min(space // size, left[size])
        filled, space, top = filled + each * size, space - each * size, top - 1
    return filled


def best_fit_plan(sizes: dict[int, int], capacities: Sequence[int], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Packs items given as size -> number.

    Returns entries (size, first rank, ranks, items a container, first
    container, capacity) sorted by size and rank, and containers
    (capacity, contents, number). Sizes must be between 1 and the largest
    capacity. Groups of containers with the same contents are one line, so the
    work depends on the number of distinct sizes, not on the number of items.
    """
    largest = max(capacities)
    ordered = sorted(capacities)
    open_: dict[int, list[tuple[int, tuple, int]]] = {}  # space left -> [(containers, contents, capacity)]
    spaces: list[int] = []
    smaller = sorted(s for s, n in sizes.items() if n)

    def add(space: int, number: int, contents: tuple, capacity: int) -> None:
        if number:
            if space not in open_:
                open_[space] = []
                heappush(spaces, space)
            open_[space].append((number, contents, capacity))

    done: list[tuple[int, tuple, int]] = []
    for size in sorted((s for s, n in sizes.items() if n), reverse=True):
        n = sizes[size]
        if not 0 < size <= largest:
            raise ValueError(f"an item of {size} fits no container")
        passed = []
        while n and spaces:
            space = heappop(spaces)
            lines = open_.pop(space)
            if space < size:  # sizes only get smaller: it may fit a later one
                passed.append((space, lines))
                continue
            each = space // size
            for number, contents, capacity in lines:
                full = min(number, n // each)
                add_later = [(space - each * size, full, ((size, each), contents), capacity)] if full else []
                n -= full * each
                number -= full
                if number and 0 < n < each:
                    add_later.append((space - n * size, 1, ((size, n), contents), capacity))
                    number, n = number - 1, 0
                passed.extend((s, [(m, c, k)]) for s, m, c, k in add_later)
                if number:
                    passed.append((space, [(number, contents, capacity)]))
        for space, lines in passed:
            for number, contents, capacity in lines:
                add(space, number, contents, capacity)
        while n:
            # Cost for each token that the container would hold, filled from this size and the smaller ones; of equal costs
            # the larger container.
            now = {**sizes, size: n}
            capacity = min((c for c in ordered if c >= size), key=lambda c: ((c + overhead) / _fill(c, smaller, now), -c))
            each = capacity // size
            full = n // each
            if full:
                add(capacity - each * size, full, ((size, each), ()), capacity)
                n -= full * each
            else:
                add(capacity - n * size, 1, ((size, n), ()), capacity)
                n = 0
        smaller.pop()
        exhausted = open_.pop(0, [])  # full containers take nothing more
        if exhausted:
            done.extend(exhausted)
            spaces = [s for s in spaces if s]
            spaces.sort()
    for space, lines in open_.items():
        done.extend(lines)
    entries, containers, first, ranks = [], [], 0, dict.fromkeys(sizes, 0)
    for number, contents, _ in done:
        parts = []
        while contents:
            parts.append(contents[0])
            contents = contents[1]
        total = sum(s * e for s, e in parts)
        capacity = next(c for c in ordered if c >= total)
        containers.append((capacity, total, number))
        for size, each in parts:
            entries.append((size, ranks[size], each * number, each, first, capacity))
            ranks[size] += each * number
        first += number
    return np.array(sorted(entries), np.int64).reshape(-1, 6), np.array(containers, np.int64).reshape(-1, 3)


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): an item larger than the largest capacity comes as pieces of that size and a rest, others whole. Items of no size are left out."""
    count = F.ceil(F.col("tokens") / capacity).cast("int")
    split = items.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return split.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * capacity).alias("size"))


def packed(items: DataFrame, capacities: Sequence[int] = (512, 1024, 2048, 4096), overhead: int = OVERHEAD) -> DataFrame:
    """(container, capacity, doc_id, piece, size) of every item of items (doc_id, tokens), each in one container.

    No item is split unless it is larger than the largest capacity; then all
    pieces but its last fill a container each. Items without tokens are in no
    container. Repeated rows are items of their own. Ties go to the lower id.
    The driver gets one line for each distinct size, at most as many as the
    largest capacity, and sends a plan of at most a few lines for each; an
    item's rank comes from counts by size and partition, so no size, however
    common, is ranked in one task.
    """
    largest = max(capacities)
    cut = staged(pieces_of(items, largest).withColumn("part", F.spark_partition_id()), "pieces")
    counted = cut.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entries, _ = best_fit_plan({r["size"]: r["n"] for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacities, overhead)
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("own", within).join(before.drop("n"), ["size", "part"]).select("doc_id", "piece", "size", (F.col("own") + F.col("before")).cast("bigint").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.int64(1) << np.int64(44)
        key = entries[:, 0] * top + entries[:, 1]
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            at = entries[np.searchsorted(key, size * top + rank, side="right") - 1]
            container = at[:, 4] + (rank - at[:, 1]) // at[:, 3]
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(at[:, 5]), batch.column("doc_id"), batch.column("piece"), batch.column("size")], ["container", "capacity", "doc_id", "piece", "size"])

    return ranked.mapInArrow(place, "container bigint, capacity bigint, doc_id bigint, piece int, size bigint")
