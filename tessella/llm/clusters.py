"""Clusters of mutually similar vectors by Markov clustering of a sparse similarity graph.

Near-copies are gathered into fine cells of their direction, no wider than the similarity threshold, so that any number of
them is one node with a weight and all vectors of a node are similar. Nodes whose mean directions are similar are linked: a k-d tree
over a bounded sample of cells cuts space into parts, every cell goes to the parts that its surroundings touch, and
the part that holds a pair's midpoint finds the pair. Markov clustering then alternates squaring of the column-stochastic
flow matrix (a distributed sparse join), inflation and pruning of small entries. Similarities are inflated before the first
squaring, too, so that pruning, which is relative to a column's strongest flow and never by number, leaves dense regions sparse.
Columns that have reached an attractor leave the computation. A column's strongest flow names its cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled
from . import vectors

SIMILAR = 0.998
DIMS = vectors.DIMS
#: A cell's diagonal is the chord between vectors of similarity ``SIMILAR``.
CELL = math.sqrt((2 - 2 * SIMILAR) / DIMS) * (1 - 1e-9)
#: Exponent of the similarity beyond the threshold, and the share of a column's strongest flow below which a flow is pruned.
POWER, PRUNED = 24, 0.005
#: Rows that one tree part is meant to hold, and those compared at once within it.
LEAF, SMALL_LEAF = 4000, 500
#: A round of more flows than ``MANY`` squares its columns in ``TURNS`` parts one after the other, so that not all of its shuffle files lie on disk together.
MANY, TURNS = 250_000, 4


def cell_of(u: Column, width: float = CELL) -> Column:
    """The grid cell of a direction as one number, seven bits an axis (coordinates lie in 0 to 1)."""
    if width < 1 / 127:
        raise ValueError("cells may not be narrower than 1/127")
    return sum((F.shiftleft(F.floor(u[i] / width).cast("long"), 7 * i) for i in range(DIMS)), F.lit(0).cast("long"))


def cells_of(docs: DataFrame, width: float = CELL) -> DataFrame:
    """(cell, n, m: the mean direction of its vectors at length one)."""
    sums = [F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(DIMS)]
    summed = docs.groupBy(cell_of(F.col("u"), width).alias("cell")).agg(F.count("*").alias("n"), *sums)
    return summed.select("cell", "n", vectors.direction(F.array(*[F.col(f"s{i}") for i in range(DIMS)])).alias("m"))


def tree_of(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """A k-d tree as arrays: the axis and the place of the cut of each inner node, in heap order."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    axis, cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
    parts = {1: points}
    for node in range(1, 1 << depth):
        p = parts.pop(node)
        if len(p):
            a = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            c = float(np.median(p[:, a]))
        else:
            a, c = 0, 0.0
        axis[node], cut[node] = a, c
        left = p[:, a] < c if len(p) else np.zeros(0, bool)
        parts[2 * node], parts[2 * node + 1] = p[left], p[~left]
    return axis, cut


def leaves_touched(tree: tuple[np.ndarray, np.ndarray], x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf within ``reach`` of each point along the axes."""
    axis, cut = tree
    rows, nodes = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    while len(nodes) and nodes[0] < len(axis):
        value, c = x[rows, axis[nodes]], cut[nodes]
        low, high = value - reach < c, value + reach >= c
        rows, nodes = np.concatenate((rows[low], rows[high])), np.concatenate((2 * nodes[low], 2 * nodes[high] + 1))
    return rows, nodes


def tree_for(cells: DataFrame, sample: int = 40000, leaf_size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A tree over all cells' space, fitted on at most about ``sample`` of them. Parts that a larger table fills beyond ``leaf_size``
    are cut further where they are searched."""
    n = cells.count()
    chosen = cells.where(F.pmod(F.xxhash64("cell"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, n)) * (1 << 20))).select("m").toPandas()
    points = np.stack(chosen["m"].to_numpy()) if len(chosen) else np.zeros((0, DIMS))
    return tree_of(points, max(1, min(n // leaf_size, sample // 8)))


def near_pairs(x: np.ndarray, similar: float, small: int = SMALL_LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (i, j, cosine), i and j differing, of directions with cosine ``similar`` or more: within the parts of a tree of these rows,
    each pair where its midpoint lies."""
    reach = math.sqrt(2 - 2 * similar) / 2 + 1e-9
    tree = tree_of(x, max(1, len(x) // small))
    rows, leaf = leaves_touched(tree, x, reach)
    order = np.argsort(leaf, kind="stable")
    homes_of, starts = np.unique(leaf[order], return_index=True)
    for home, part in zip(homes_of, np.split(rows[order], starts[1:]), strict=True):
        y = x[part]
        for at in range(0, len(part), 512):
            i, j = np.nonzero(y[at : at + 512] @ y.T >= similar)
            i += at
            other = i != j
            i, j = part[i[other]], part[j[other]]
            if len(i):
                where, homes = leaves_touched(tree, (x[i] + x[j]) / 2, 0.0)
                mine = np.zeros(len(i), dtype=bool)
                mine[where] = homes == home
                i, j = i[mine], j[mine]
                yield i, j, np.einsum("ij,ij->i", x[i], x[j])


def links_of(cells: DataFrame, similar: float = SIMILAR, power: float = POWER, least: float = PRUNED, tree: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, reach). ``links``: flows (src, dst, w) of each cell to itself (no stronger than its strongest link) and to similar cells; another flow's strength is the target's weight times a power of the
    similarity beyond the threshold, and flows below ``least`` of the column's strongest are pruned. ``reach``: (cell, reach, lead), the number of vectors in the cell and in
    all similar ones, and the smallest of these cells.
    """
    tree = tree or tree_for(cells)
    reach = math.sqrt(2 - 2 * similar) / 2 + 1e-9

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows, leaf = leaves_touched(tree, np.stack(b["m"].to_numpy()), reach)
                yield b.iloc[rows].assign(leaf=leaf)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        leaf = int(part["leaf"].iloc[0])
        ids, weight, x = part["cell"].to_numpy(), part["n"].to_numpy(dtype=np.float64), np.stack(part["m"].to_numpy())
        total, first = np.zeros(len(x)), ids.copy()
        src, dst, strength = [], [], []
        for i, j, near in near_pairs(x, similar - 1e-12):
            rows, homes = leaves_touched(tree, (x[i] + x[j]) / 2, 0.0)
            mine = np.zeros(len(i), dtype=bool)
            mine[rows] = homes == leaf
            i, j, near = i[mine], j[mine], near[mine]
            np.add.at(total, i, weight[j])
            np.minimum.at(first, i, ids[j])
            w = weight[j] * np.clip((near - similar) / (1 - similar), 0.0, 1.0) ** power
            src.append(i), dst.append(j), strength.append(w)
        seen = np.flatnonzero(total)
        none = np.zeros(0, dtype=np.int64)
        i, j, w = np.concatenate([none, *src]), np.concatenate([none, *dst]), np.concatenate([np.zeros(0), *strength])
        most = np.zeros(len(x))
        np.maximum.at(most, i, w)
        keep = w * 1.05 >= least * most[i]  # the column's strongest is no weaker than the strongest here
        flows = pd.DataFrame({"src": ids[i[keep]], "dst": ids[j[keep]], "w": w[keep], "met": 0.0})
        return pd.concat([flows, pd.DataFrame({"src": ids[seen], "dst": first[seen], "w": 0.0, "met": total[seen]})])

    found = settled(cells.mapInPandas(send, "cell long, n long, m array<double>, leaf long").groupBy("leaf").applyInPandas(pairs, "src long, dst long, w double, met double"))
    met = found.where("met > 0").select(F.col("src").alias("cell"), F.col("dst").alias("lead"), "met")
    met = met.unionByName(cells.select("cell", F.col("cell").alias("lead"), F.col("n").cast("double").alias("met")))
    every = found.where("met = 0").select("src", "dst", "w").unionByName(cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.col("n").cast("double").alias("w")))
    others = F.max(F.when(F.col("src") != F.col("dst"), F.col("w"))).over(Window.partitionBy("src"))
    every = every.withColumn("w", F.when(F.col("src") == F.col("dst"), F.least("w", others)).otherwise(F.col("w")))  # a loop is no stronger than the strongest link
    favoured = F.col("w") * (1 + F.lit(0.05) * F.pmod(F.xxhash64("dst"), F.lit(1000)) / 1000)  # else equal attractors would share their columns for ever
    return stochastic(every.withColumn("w", favoured), least).drop("k"), met.groupBy("cell").agg(F.sum("met").cast("long").alias("reach"), F.min("lead").alias("lead"))


def stochastic(flows: DataFrame, least: float = PRUNED) -> DataFrame:
    """The flows of each column scaled to sum to one, and how many they are (``k``). Pruned are those below ``least`` of the column's strongest,
    so that equal flows stay together, however many they are."""
    per = Window.partitionBy("src")
    kept = flows.withColumn("most", F.max("w").over(per)).where(F.col("w") >= least * F.col("most"))
    return kept.select("src", "dst", (F.col("w") / F.sum("w").over(per)).alias("w"), F.count("*").over(per).alias("k"))


def _squared(active: DataFrame, whole: DataFrame, inflation: float, least: float) -> DataFrame:
    squared = active.join(whole, active["dst"] == whole["mid"]).groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
    return stochastic(squared.withColumn("w", F.pow("w", F.lit(inflation))), least)


def markov_clusters(links: DataFrame, inflation: float = 2.0, least: float = PRUNED, rounds: int = 12) -> DataFrame:
    """(cell, cluster, flow): the attractor of each column of the limit and the flow that reaches it.

    A column with one flow left is as its target's column from then on, so it leaves the squaring as a pointer; pointers are
    followed to their ends last. Columns that neither flow to others nor are flowed to never enter. What is still divided after
    ``rounds`` (the matrix to the power 2 to that number) points to its strongest flow, ties by the smaller cell.
    """
    flows = settled(links.select("src", "dst", "w", F.count("*").over(Window.partitionBy("src")).alias("k")))
    met = flows.where("src <> dst").select(F.col("src").alias("cell")).unionByName(flows.where("src <> dst").select(F.col("dst").alias("cell"))).distinct()
    met = settled(met)
    alone = flows.join(met, flows["src"] == met["cell"], "left_anti").select("src", "dst", "w")
    inside = flows.join(met, flows["src"] == met["cell"], "left_semi")
    # all columns are written anew in each round, so that the plan doesn't grow with the rounds
    state = inside.select("src", "dst", "w", "k")
    for turn in range(rounds):
        active = state.where("k > 1").select("src", "dst", "w")
        left = active.count()
        if not left:
            break
        whole = state.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        parts = TURNS if left > MANY else 1
        done = [_squared(active.where(F.pmod(F.xxhash64("src"), F.lit(parts)) == part) if parts > 1 else active, whole, inflation, least) for part in range(parts)]
        now = done[0] if parts == 1 else reduce(DataFrame.unionByName, [settled(d) for d in done])
        state = settled(now.unionByName(state.where("k = 1")))
    best = state.groupBy("src").agg(F.max(F.struct("w", (-F.col("dst")).alias("neg"))).alias("best"))
    ends = followed(best.select("src", (-F.col("best.neg")).alias("dst"), F.col("best.w").alias("w")))
    return alone.select("src", "dst", "w").unionByName(ends).select(F.col("src").alias("cell"), F.col("dst").alias("cluster"), F.col("w").alias("flow"))


def followed(pointers: DataFrame, rounds: int = 20) -> DataFrame:
    """Pointers (src, dst, w) taken to their ends by doubling; of two cells that point at each other the smaller is the end."""

    def hop(at: DataFrame) -> DataFrame:
        after = at.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        return at.join(after, at["dst"] == after["mid"], "left").select("src", "dst", "w", F.coalesce("to", "dst").alias("to"))

    twice = hop(pointers)
    at = settled(twice.select("src", F.when((F.col("to") == F.col("src")) & (F.col("src") < F.col("dst")), F.col("src")).otherwise(F.col("dst")).alias("dst"), "w"))
    for _ in range(rounds):
        now = settled(hop(at))
        at = now.select("src", F.col("to").alias("dst"), "w")
        if now.where("to <> dst").isEmpty():
            break
    return at


def clustered(df: DataFrame, id_col: str = "doc_id", vector_col: str = "vector", width: float = CELL, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Markov clusters of a table's valid vectors: (docs, members).

    ``docs``: (doc_id, u, cell), one row for each id with a valid vector; ``members``: (cell, cluster, flow, n, m, reach, lead) for every cell. Every valid vector is in
    exactly one cluster, one without similar ones in a cluster of its own. Invalid vectors (null, not ``DIMS`` finite
    numbers, negative, all zero) are left out; an empty table gives none. Extra columns are dropped.
    """
    docs = settled(vectors.directions(df, id_col, vector_col).withColumn("cell", cell_of(F.col("u"), width)))
    cells = settled(cells_of(docs, width))
    links, reach = links_of(cells, similar)
    return docs, settled(markov_clusters(links).join(cells, "cell").join(reach, "cell"))


def centres_of(members: DataFrame) -> DataFrame:
    """(cluster, size, c: its mean direction)."""
    sums = [F.sum(F.col("m")[i] * F.col("n")).alias(f"s{i}") for i in range(DIMS)]
    summed = members.groupBy("cluster").agg(F.sum("n").alias("size"), *sums)
    return summed.select("cluster", "size", vectors.direction(F.array(*[F.col(f"s{i}") for i in range(DIMS)])).alias("c"))


def described(docs: DataFrame, members: DataFrame, typical: int = 3, least_size: int = 1) -> DataFrame:
    """One row per cluster: ``cluster``, ``size``, ``typical_1`` .. ``typical_k``, the ids by strongest flow, then nearest to the centre."""
    centres = centres_of(members).where(F.col("size") >= least_size)
    dot = sum((F.col("u")[i] * F.col("c")[i] for i in range(DIMS)), F.lit(0.0))
    placed = docs.join(members.select("cell", "cluster", "flow"), "cell").join(centres, "cluster").withColumn("near", F.round(dot, 9))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("flow", 6)), F.desc("near"), "doc_id")
    top = placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= typical)
    picks = [F.max(F.when(F.col("r") == i + 1, F.col("doc_id"))).alias(f"typical_{i + 1}") for i in range(typical)]
    return top.groupBy("cluster").agg(F.first("size").alias("size"), *picks)


# --- tight groups: an exact check of the clusters ---------------------------------------------------

GROUP, APART, LEAST = 0.998, 0.99, 20
BLOCK = 4096


def angle(cosine: Column | float) -> Column:
    c = F.lit(cosine) if isinstance(cosine, float) else cosine
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def cells_around(cells: DataFrame, points: DataFrame, tree: tuple[np.ndarray, np.ndarray], least: float, refuting: tuple[float, float]) -> DataFrame:
    """(cluster, c, cell) for every cell whose mean has cosine ``least`` or more with a point (cluster, c); cell is null where a cell of one vector with a cosine within
    ``refuting`` refutes the point. Every part of the tree compares its cells with the points that come so close to it."""
    reach = math.sqrt(2 - 2 * least) + 1e-9

    def homes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows, leaf = leaves_touched(tree, np.stack(b["m"].to_numpy()), 0.0)
                yield b.iloc[rows].assign(leaf=leaf)

    def visits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows, leaf = leaves_touched(tree, np.stack(b["c"].to_numpy()), reach)
                yield b.iloc[rows].assign(leaf=leaf)

    def meet(near: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(asked):
            x, alone, ids = np.stack(near["m"].to_numpy()), near["n"].to_numpy() == 1, near["cell"].to_numpy()
            q, names = np.stack(asked["c"].to_numpy()), asked["cluster"].to_numpy()
            for start in range(0, len(q), 256):
                s = q[start : start + 256] @ x.T
                bad = ((s >= refuting[0]) & (s < refuting[1]) & alone).any(axis=1)
                i, j = np.nonzero((s >= least) & ~bad[:, None])
                out.append(pd.DataFrame({"cluster": names[start + i], "cell": pd.array(ids[j], dtype="Int64")}))
                out.append(pd.DataFrame({"cluster": names[start + np.flatnonzero(bad)], "cell": pd.array([None] * int(bad.sum()), dtype="Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"cluster": pd.array([], dtype="Int64"), "cell": pd.array([], dtype="Int64")})

    home = cells.select("cell", "n", "m").mapInPandas(homes, "cell long, n long, m array<double>, leaf long").groupBy("leaf")
    visit = points.mapInPandas(visits, "cluster long, c array<double>, leaf long").groupBy("leaf")
    return home.cogroup(visit).applyInPandas(meet, "cluster long, cell long")


def tight_groups(docs: DataFrame, members: DataFrame, group: float = GROUP, apart: float = APART, least: int = LEAST) -> DataFrame:
    """(doc_id, group_key) of each set of at least ``least`` vectors of which any two have cosine ``group`` and which no other
    vector comes within cosine ``apart`` of.

    Clusters give the candidates. All cells of such a group are linked with each other and with no other, so they reach the same cells and vectors; a
    cluster whose cells don't, or which reaches vectors that its lead's cells don't hold, is no part of a group, and of clusters with the same lead one is
    enough. The centre of any part of a group is within ``group`` of all
    of its vectors, and every other vector is below ``apart / sqrt(group)`` of it; so a candidate's ball of cosine ``group`` is the
    group, and a vector between both bounds refutes it. What the bounds leave open is compared pair by pair in blocks.
    """
    bound = apart / math.sqrt(group)
    cells = members.select("cell", "n", "m")
    # what all cells of one lead hold is what each of them reaches, if they are a group
    leads = members.groupBy("lead").agg(F.sum("n").alias("held"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    leads = leads.where((F.col("low") == F.col("high")) & (F.col("low") == F.col("held")) & (F.col("held") >= least)).select("lead")
    parts = members.groupBy("cluster").agg(F.min("lead").alias("lead"), F.max("lead").alias("last"), F.sum("n").alias("size")).where("lead = last")
    chosen = parts.join(leads, "lead").groupBy("lead").agg(F.max_by("cluster", F.struct("size", "cluster")).alias("cluster"))
    points = settled(centres_of(members).join(chosen, "cluster", "left_semi").select("cluster", "c"))
    tree = tree_for(cells)
    first = cells_around(cells, points, tree, bound, (bound + 1e-9, group - 1e-9))
    left = first.groupBy("cluster").agg(F.bool_and(F.col("cell").isNotNull()).alias("fine")).where("fine")
    points = settled(points.join(left, "cluster", "left_semi"))
    # farther off may lie vectors that are too close to a member; a cell's vectors are within its diagonal of its mean
    widest = math.acos(apart) + math.acos(group) + 2 * math.asin(CELL * math.sqrt(DIMS) / 2)
    pairs = cells_around(cells, points, tree, math.cos(widest + 1e-6), (2.0, 2.0)).join(points, "cluster")
    dot = sum((F.col("u")[i] * F.col("c")[i] for i in range(DIMS)), F.lit(0.0))
    near = settled(docs.join(pairs, "cell").select("cluster", "doc_id", "u", dot.alias("s")))
    stats = near.groupBy("cluster").agg(
        F.count_if(F.col("s") >= group).alias("n"),
        F.count_if((F.col("s") >= bound) & (F.col("s") < group)).alias("shell"),
        F.min(F.when(F.col("s") >= group, F.col("s"))).alias("low"),
    )
    good = stats.where((F.col("n") >= least) & (F.col("shell") == 0)).select("cluster", angle(F.col("low")).alias("wide"))
    # any two members lie within twice the widest angle; only members beyond the rest of it can be too far apart
    good = good.select(
        "cluster",
        F.cos(angle(apart) + F.col("wide") + 1e-9).alias("outer"),
        F.when(2 * F.col("wide") > angle(group), F.cos(F.greatest(angle(group) - F.col("wide"), F.lit(0.0))) - 1e-12).otherwise(F.lit(-2.0)).alias("far"),
    )
    kind = F.when(F.col("s") >= group, F.when(F.col("s") <= F.col("far"), "far").otherwise("in")).when(F.col("s") >= F.col("outer"), "out")
    rows = settled(near.join(good, "cluster").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("cluster", "doc_id", "kind", "u"))
    fine = rows.where("kind <> 'out'").join(_broken(rows, group, apart), "cluster", "left_anti")
    keys = fine.groupBy("cluster").agg(F.min("doc_id").alias("group_key"))
    one = keys.groupBy("group_key").agg(F.min("cluster").alias("cluster"))  # several parts of a group give the same ball
    return fine.join(one, "cluster").select("doc_id", "group_key")


def _broken(rows: DataFrame, group: float, apart: float) -> DataFrame:
    """Clusters with two members too far apart, or a member too close to another vector.

    Both are comparisons of one side's rows with another's, cut into blocks of ``BLOCK // 2`` rows by a hash and paired block by block.
    """
    size = BLOCK // 2
    tally = rows.groupBy("cluster").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") == "far") / size)).cast("int").alias("n_far"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") == "out") / size)).cast("int").alias("n_out"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") != "out") / size)).cast("int").alias("n_in"),
        F.count_if(F.col("kind") == "far").alias("fars"),
        F.count_if(F.col("kind") == "out").alias("outs"),
    )
    known = rows.join(tally.where("fars > 1 OR outs > 0"), "cluster").withColumn("h", F.abs(F.hash("doc_id", F.lit(7))))

    def side(df: DataFrame, task: str, which: str, own: str, other: str) -> DataFrame:
        mine, theirs = F.pmod("h", F.col(own)), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        out = df.select("cluster", F.lit(task).alias("task"), F.lit(which).alias("side"), mine.alias("mine"), theirs.alias("theirs"), "u")
        a, b = ("mine", "theirs") if which == "a" else ("theirs", "mine")
        return out.select("cluster", "task", "side", F.col(a).alias("a"), F.col(b).alias("b"), "u")

    is_far, is_out, is_in = known.where("kind = 'far' and fars > 1"), known.where("kind = 'out'"), known.where("kind <> 'out' and outs > 0")
    sides = (
        side(is_far, "wide", "a", "n_far", "n_far")
        .unionByName(side(is_far, "wide", "b", "n_far", "n_far"))
        .unionByName(side(is_in, "near", "a", "n_in", "n_out"))
        .unionByName(side(is_out, "near", "b", "n_out", "n_in"))
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["side"] == "a"], part[part["side"] == "b"]
        bad = False
        if len(a) and len(b):
            x, y = np.stack(a["u"].to_numpy()), np.stack(b["u"].to_numpy())
            for start in range(0, len(x), 512):
                s = x[start : start + 512] @ y.T
                bad |= bool((s < group).any() if part["task"].iloc[0] == "wide" else (s >= apart).any())
        return pd.DataFrame({"cluster": part["cluster"].iloc[:1] if bad else part["cluster"].iloc[:0]})

    return sides.groupBy("cluster", "task", "a", "b").applyInPandas(compare, "cluster long").distinct()
