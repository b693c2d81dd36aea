"""The most similar vectors of each query vector, by a permutation index.

Every vector is represented by its nearest pivots in order. Pivots are chosen far apart from a bounded
sample (``sample`` rows); all vectors are indexed. Postings are spread by pivot: a list holds the vectors whose nearest pivot is the same,
and a long list is cut into shares of at most about ``SHARE`` rows. Each query first ranks a fixed part of its own pivot's list by the footrule distance of
the two orders of pivots and compares the best exactly; the ``k``-th of these (or of the sample) bounds how far its neighbours can lie. Then every list that may hold a vector within the bound is compared
exactly, so the result is complete. A list is left out only if it lies wholly beyond the bound: no vector of it is nearer to the query than the plane halfway between its pivot and another one, nor than
the pivot's distance less the list's radius. Queries and vectors meet by list in a shuffle; nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled
from . import vectors

DIMS = vectors.DIMS
UNITS = [f"u{i}" for i in range(DIMS)]
#: Rows of a list that are compared at once, and similarities held at once.
SHARE, HELD = 65536, 1 << 21
#: Share of the rows of a posting structure that are compared exactly at least when the bound is looked for; the share of all vectors it is looked for in is one of ``FIRST``.
PART, FIRST = 0.05, 8


def sample_of(docs: DataFrame, sample: int, seed: int = 5) -> np.ndarray:
    """The different directions of a sample of at most about ``sample`` rows."""
    n = docs.count()
    part = min(1.0, sample / max(1, n))
    got = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy("doc_id").limit(2 * sample).select("u").toPandas()
    return np.unique(np.stack(got["u"].to_numpy()), axis=0) if len(got) else np.zeros((0, DIMS))


def pivots_of(x: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other (farthest-first traversal) among different directions."""
    if not len(x):
        return x
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(count, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    return x[chosen]


class Postings:
    """Inverted files of one share of the vectors."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.x, self.prefix, self.n = x, min(prefix, len(pivots)), len(x)
        order = orders(x, pivots, self.prefix)
        flat = order.ravel() * self.prefix + np.tile(np.arange(self.prefix), self.n)
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.prefix).astype(np.int32)
        self.at = np.searchsorted(flat[by], np.arange(len(pivots) * self.prefix + 1))

    def gains(self, order: np.ndarray) -> np.ndarray:
        """How much less than the largest the footrule distance of every vector to a query's order is, halved: a shared
        pivot saves the prefix length less the worse of its two ranks."""
        got = np.zeros(self.n, dtype=np.uint16)
        for rank, pivot in enumerate(order):
            base = pivot * self.prefix
            got[self.rows[self.at[base] : self.at[base + rank + 1]]] += self.prefix - rank
            for other in range(rank + 1, self.prefix):
                got[self.rows[self.at[base + other] : self.at[base + other + 1]]] += self.prefix - other
        return got

    def best(self, query: np.ndarray, order: np.ndarray, candidates: int) -> np.ndarray:
        """The vectors among the first ``candidates`` by footrule, ties with the last included. The distance of the last
        is found by halving."""
        got = self.gains(order)
        low, high = 0, self.prefix * (self.prefix + 1) // 2 + 1  # at least ``candidates`` reach low, fewer reach high
        wanted = min(candidates, self.n)
        while high - low > 1:
            middle = (low + high) // 2
            if np.count_nonzero(got >= middle) >= wanted:
                low = middle
            else:
                high = middle
        return np.flatnonzero(got >= low)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    out = np.zeros((len(x), prefix), dtype=np.int64)
    for start in range(0, len(x), 8192):
        s = x[start : start + 8192] @ pivots.T
        part = np.argpartition(-s, min(prefix, s.shape[1] - 1), axis=1)[:, :prefix] if prefix < s.shape[1] else np.tile(np.arange(prefix), (len(s), 1))
        near = np.take_along_axis(s, part, axis=1)
        out[start : start + 8192] = np.take_along_axis(part, np.argsort(-near, axis=1, kind="stable"), axis=1)
    return out


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of the axes, so that a pair's cosine doesn't depend on what is compared with it; at 14 places."""
    total = np.zeros(len(x))
    for i in range(DIMS):
        total += x[:, i] * q[:, i]
    return np.round(total, 14)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def lists_within(q: np.ndarray, reach: np.ndarray, marks: np.ndarray, radius: np.ndarray, others: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) for every list that may hold a vector within a query's ``reach``. A list's vectors are nearer to its pivot than to any other, and within ``radius`` of it."""
    s = q @ marks.T
    apart = distance(marks @ marks.T)
    low = distance(s) - radius
    for p in np.argsort(-s, axis=1, kind="stable")[:, :others].T:
        between = apart[p]
        low = np.maximum(low, np.divide(s[np.arange(len(q)), p][:, None] - s, between, out=np.zeros_like(s), where=between > 1e-6))
    return np.nonzero(low <= reach[:, None] + 1e-7)


def nearest(docs: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 512, prefix: int = 10, candidates: int = 2400, sample: int = 20000) -> DataFrame:
    """(query_id, doc_id, cosine, rank) of the ``k`` vectors most similar to each query, itself left out.

    ``docs`` and ``queries`` hold ``doc_id`` and ``u``, a direction (``vectors.directions``). Ties in cosine go by id. Fewer than ``k`` other vectors give fewer rows.
    """
    spark = docs.sparkSession
    known = sample_of(docs, sample)
    marks = pivots_of(known, pivots)
    if not len(marks):
        return spark.createDataFrame([], "query_id string, doc_id string, cosine double, rank int")
    listed = _listed(docs, marks)
    tally = listed.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).toPandas()
    rows, radius = np.zeros(len(marks)), np.full(len(marks), -np.inf)  # a list without vectors is never reached
    rows[tally["list"]], radius[tally["list"]] = tally["n"], distance(tally["near"].to_numpy())
    radius = np.where(np.isfinite(radius), radius, -10.0)
    asked = settled(queries.select(F.col("doc_id").alias("query_id"), *[F.col("u")[i].alias(c) for i, c in enumerate(UNITS)]))

    def first(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, least = b[UNITS].to_numpy(), np.full(len(b), -2.0)
            s = q @ marks.T
            home = np.argmax(s, axis=1)
            if len(known) > k:
                for at in range(0, len(q), 64):
                    least[at : at + 64] = np.partition(q[at : at + 64] @ known.T, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
            yield b.assign(least=least, list=home)

    def visits(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                row, home = lists_within(part[UNITS].to_numpy(), distance(part["least"].to_numpy()), marks, radius)
                yield part.iloc[row].assign(list=home)

    kinds = ", ".join(f"{c} double" for c in UNITS)
    start = settled(asked.mapInPandas(first, f"query_id string, {kinds}, least double, list int"))
    some = listed.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FIRST)) == 0)
    met = _met(some, start, np.ceil(rows / FIRST / SHARE), k, (marks, prefix, candidates))
    best = met.groupBy("query_id").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c")).select("query_id", F.get("c", F.lit(k - 1)).alias("found"))
    bound = F.greatest("least", F.coalesce("found", F.lit(-2.0)))
    bounded = settled(start.drop("list").join(best, "query_id", "left").select("query_id", *UNITS, bound.alias("least")))
    found = _met(listed, bounded.mapInPandas(visits, f"query_id string, {kinds}, least double, list int"), np.ceil(rows / SHARE), k)
    per = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "doc_id")
    return found.withColumn("rank", F.row_number().over(per).cast("int")).where(F.col("rank") <= k)


def _listed(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """The vectors with the list they are in and the cosine of its pivot."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in UNITS])
            home, near = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for at in range(0, len(x), 4096):
                s = x[at : at + 4096] @ marks.T
                home[at : at + 4096], near[at : at + 4096] = np.argmax(s, axis=1), np.max(s, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(near)], names=[*b.schema.names, "list", "near"])

    wide = docs.select("doc_id", *[F.col("u")[i].alias(c) for i, c in enumerate(UNITS)])
    return wide.mapInArrow(assign, f"doc_id string, {', '.join(f'{c} double' for c in UNITS)}, list int, near double")


def _met(listed: DataFrame, visits: DataFrame, shares: np.ndarray, k: int, ranked: tuple[np.ndarray, int, int] | None = None) -> DataFrame:
    """(query_id, doc_id, cosine): of each share of a list the ``k`` vectors most similar to each query that visits the list, if their cosine is ``least`` or more. ``ranked``: pivots, prefix and number of candidates, if only the
    best by footrule are to be compared."""
    spark = listed.sparkSession
    cut = spark.createDataFrame([(i, int(max(1, n))) for i, n in enumerate(shares)], "list int, shares int")
    near = listed.drop("near").join(F.broadcast(cut), "list").withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("shares")).cast("int")).drop("shares")
    asked = visits.join(F.broadcast(cut), "list").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def meet(near: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype=str), "doc_id": pd.Series([], dtype=str), "cosine": pd.Series([], dtype=float)})]
        if len(near) and len(asked):
            x, ids, q, names, least = near[UNITS].to_numpy(), near["doc_id"].to_numpy(), asked[UNITS].to_numpy(), asked["query_id"].to_numpy(), asked["least"].to_numpy() - 1e-12
            by_rank = ranked is not None and len(x) > ranked[2]  # else all are candidates
            if by_rank:
                marks, prefix, candidates = ranked
                post, order_q = Postings(x, marks, prefix), orders(q, marks, min(prefix, len(marks)))
            step = 1 if by_rank else max(1, HELD // len(x))
            for at in range(0, len(q), step):
                y, low, own = q[at : at + step], least[at : at + step].copy(), names[at : at + step]
                rows = post.best(y[0], order_q[at], max(candidates, int(PART * len(x)))) if by_rank else None
                s = y @ (x if rows is None else x[rows]).T
                hit = s >= low[:, None]
                many = np.flatnonzero(hit.sum(axis=1) > 4 * (k + 1))
                if len(many):
                    kth = np.partition(s[many], s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                    hit[many] = s[many] >= np.maximum(low[many], kth - 1e-12)[:, None]
                i, j = np.nonzero(hit)
                j = j if rows is None else rows[j]
                other = ids[j] != own[i]
                i, j = i[other], j[other]
                if len(i):
                    c = cosines(x[j], y[i])
                    held, back = np.unique(j, return_inverse=True)
                    place = np.argsort(np.argsort(ids[held], kind="stable"), kind="stable")[back]
                    by = np.lexsort((place, -c, i))
                    i, j, c = i[by], j[by], c[by]
                    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    best = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) < k
                    out.append(pd.DataFrame({"query_id": own[i[best]], "doc_id": ids[j[best]], "cosine": c[best]}))
        return pd.concat(out)

    keys = ["list", "share"]
    return near.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id string, doc_id string, cosine double")


def unordered(found: DataFrame) -> DataFrame:
    """(doc_a, doc_b): each pair of a query and a neighbour once, the smaller id first."""
    return found.select(F.least("query_id", "doc_id").alias("doc_a"), F.greatest("query_id", "doc_id").alias("doc_b")).distinct()
