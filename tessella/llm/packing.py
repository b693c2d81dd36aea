"""Filling containers of fixed capacity with items of varying size.

Only the numbers of items per size enter the plan, so it is made on the driver from a table that the
capacity bounds. Containers are opened with the largest size left; when up to three more sizes can
fill the gap exactly (found by looking up complements), they do, as often as all of them are in
stock; otherwise the largest size that fits goes in, and what can't be filled exactly is closed by
best fit. The plan hands out ranks of each size to containers; items take theirs by a salted rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled

#: Items of one size that are ranked together.
RANKED = 250_000


def exact_fill(stock: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three sizes in stock that add up to the gap exactly, large ones first."""
    if stock[gap] > 0:
        return [gap]
    there = stock[: gap + 1] > 0
    both = there & there[::-1]
    both[0] = both[gap] = False
    for a in np.flatnonzero(both)[::-1]:
        if 2 * a != gap or stock[a] > 1:
            return [int(a), gap - int(a)]
    sizes = np.flatnonzero(there)
    sizes = sizes[sizes > 0][::-1]
    for a in sizes:
        rest = gap - int(a)
        if rest < 2:
            continue
        part = there[: rest + 1]
        pair = part & part[::-1]
        pair[0] = pair[rest] = False
        for b in np.flatnonzero(pair)[::-1]:  # fails only where two of the three sizes are equal
            need = Counter([int(a), int(b), rest - int(b)])
            if all(stock[s] >= n for s, n in need.items()):
                return [int(a), int(b), rest - int(b)]
    return None


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, sizes) for each way of filling a container. Every step uses up a size or all that its multiples
    allow, so the number of steps depends on the capacity alone."""
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} doesn't fit a capacity of {capacity}")
        stock[size] = n
    plan: list[tuple[int, list[int]]] = []
    while (left := np.flatnonzero(stock)).size:
        chosen = [int(left[-1])]
        stock[chosen[0]] -= 1
        gap = capacity - chosen[0]
        while gap > 0:
            fitting = np.flatnonzero(stock[: gap + 1])
            if not fitting.size:
                break
            most = int(fitting[-1])
            more = exact_fill(stock, gap) if gap <= 3 * most else None
            for s in more or [most]:
                chosen.append(s)
                stock[s] -= 1
                gap -= s
            if more:
                break
        for s in chosen:
            stock[s] += 1
        need = Counter(chosen)
        times = min(int(stock[s]) // n for s, n in need.items())
        for s, n in need.items():
            stock[s] -= times * n
        plan.append((times, chosen))
    return plan


def pieces_of(sizes: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Items in parts of at most the capacity: an item within it is one part, a larger one is split into full parts and a rest."""
    parts = F.ceil(F.col("tokens") / capacity).cast("int")
    return (
        sizes.where(F.col("tokens") > 0)
        .select(id_col, "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
        .withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("part_no") * capacity).cast("int"))
    )


def packed(sizes: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """A container for every item of ``sizes`` (id, ``tokens``): id, ``part_no``, ``size``, ``container_no``.

    Items without tokens (or with null) take no room and give no row. Rows that repeat an id are items of their own;
    extra columns are dropped. A size of more than ``RANKED`` items is ranked in salted parts, as many as its count asks for, so a size that holds a third
    of all items is not sorted in one task. What comes to the driver are a count per size, and one per part: the capacity and a ``RANKED``-th of the items bound them.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = sizes.sparkSession
    cut = settled(pieces_of(sizes.select(id_col, "tokens"), id_col, capacity))
    counts = {int(r["size"]): int(r["n"]) for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(s, -(-n // RANKED)) for s, n in counts.items() if n > RANKED], "size int, salts int")
    salted = cut.join(F.broadcast(salts), "size", "left")  # at most a row for each size up to the capacity
    parts = salted.withColumn("salt", F.pmod(F.xxhash64(id_col, "part_no"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    stock = parts.groupBy("size", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["size", "salt"])
    starts: dict[int, np.ndarray] = {}
    for size, one in stock.groupby("size"):
        begin = np.zeros(int(one["salt"].max()) + 1, dtype=np.int64)
        begin[one["salt"]] = one["n"].cumsum() - one["n"]
        starts[int(size)] = begin
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    first = 0
    for times, chosen in packing_plan(counts, capacity):
        for s, n in Counter(chosen).items():
            ranges.setdefault(s, []).append((used[s], first, n))
            used[s] += times * n
        first += times
    lookup = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in ranges.items()}
    sent = spark.sparkContext.broadcast((starts, lookup))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, lookup = sent.value
        for b in batches:
            out = np.zeros(len(b), dtype=np.int64)
            size, salt, rank = b["size"].to_numpy(), b["salt"].to_numpy(), b["rank"].to_numpy(dtype=np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                at, box, each = lookup[int(s)]
                r = starts[int(s)][salt[mine]] + rank[mine]
                i = np.searchsorted(at, r, side="right") - 1
                out[mine] = box[i] + (r - at[i]) // each[i]
            yield b[[id_col, "part_no", "size"]].assign(container_no=out)

    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(id_col, "part_no")) - 1)
    kind = sizes.schema[id_col].dataType.simpleString()
    return ranked.mapInPandas(place, f"`{id_col}` {kind}, part_no int, size int, container_no long")


def oversized(sizes: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Items that had to be split: those with more than one part."""
    return pieces_of(sizes, id_col, capacity).where("part_no = 1").select(id_col)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, how full they are together, and the emptiest containers' number (under half full)."""
    boxes = placed.groupBy("container_no").agg(F.sum("size").alias("filled"), F.count("*").alias("parts"))
    return boxes.agg(
        F.count("*").alias("containers"),
        F.sum("parts").alias("parts"),
        F.round(F.sum("filled") / (F.count("*") * capacity), 6).alias("fill"),
        F.count_if(F.col("filled") == capacity).alias("full"),
        F.count_if(F.col("filled") > capacity).alias("overfull"),
        F.count_if(F.col("filled") * 2 < capacity).alias("under_half"),
    )
