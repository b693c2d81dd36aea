"""Combining sources to target shares of a corpus's tokens.

Documents of the same text may stand in several sources. They are aggregated by the set of sources that hold their
text (the membership pattern). A min-cost flow routes the patterns' tokens to the sources' quotas: each further use of a pattern's
texts costs more than the one before (a convex cost), and no source can give more than its documents times their
allowed uses. The flow's size depends on the numbers of patterns and sources; documents are then
selected per pattern and source by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled

BUCKETS = 4096


@dataclass
class Arc:
    to: int
    room: float
    cost: float
    back: int
    flow: float = 0.0


class Network:
    """A flow network solved by successive cheapest paths."""

    def __init__(self, nodes: int):
        self.arcs: list[list[Arc]] = [[] for _ in range(nodes)]

    def link(self, a: int, b: int, room: float, cost: float) -> Arc:
        arc = Arc(b, room, cost, len(self.arcs[b]))
        self.arcs[a].append(arc)
        self.arcs[b].append(Arc(a, 0.0, -cost, len(self.arcs[a]) - 1))
        return arc

    def solve(self, source: int, sink: int, least: float = 1e-6) -> None:
        """Send as much as can flow, at the least cost."""
        n = len(self.arcs)
        while True:
            cost, via = [float("inf")] * n, [None] * n
            cost[source] = 0.0
            queue, queued = [source], [False] * n
            while queue:
                a = queue.pop(0)
                queued[a] = False
                for arc in self.arcs[a]:
                    if arc.room > least and cost[a] + arc.cost < cost[arc.to] - 1e-12:
                        cost[arc.to], via[arc.to] = cost[a] + arc.cost, (a, arc)
                        if not queued[arc.to]:
                            queue.append(arc.to)
                            queued[arc.to] = True
            if via[sink] is None:
                return
            path, at = [], sink
            while at != source:
                at, arc = via[at]
                path.append(arc)
            amount = min(arc.room for arc in path)
            for arc in path:
                arc.room -= amount
                arc.flow += amount
                back = self.arcs[arc.to][arc.back]
                back.room += amount
                back.flow -= amount


def routed(holdings: dict[tuple[str, str], float], distinct: dict[str, float], quotas: dict[str, float], repeats: dict[str, int]) -> dict[tuple[str, str], float]:
    """Tokens that each (pattern, source) gives. ``holdings``: tokens of the documents in a source with a pattern;
    ``distinct``: tokens of a pattern's texts, each counted once."""
    patterns, sources = sorted({p for p, _ in holdings}), sorted(quotas)
    place = {p: 1 + i for i, p in enumerate(patterns)} | {("source", s): 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    net = Network(sink + 1)
    for p in patterns:
        most = sum(t * repeats[s] for (q, s), t in holdings.items() if q == p)
        uses = 0
        while most > 1e-9 and distinct.get(p, 0) > 0:
            room = min(most, distinct[p])
            net.link(0, place[p], room, float(uses))
            most -= room
            uses += 1
    arcs = {(p, s): net.link(place[p], place["source", s], t * repeats[s], 0.0) for (p, s), t in holdings.items()}
    for s in sources:
        net.link(place["source", s], sink, quotas[s], 0.0)
    net.solve(0, sink)
    return {k: a.flow for k, a in arcs.items()}


def mixed(sizes: DataFrame, targets: DataFrame, id_col: str, source_col: str = "source", digest_col: str = "digest", total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and the shares reached.

    ``sizes`` holds id, source, ``tokens`` and a digest of the text; ``targets`` holds ``source``, ``target_share``, ``max_repeats`` (a small table,
    one row per source). Sources are compared without blanks around them and capitals; documents of other or null sources
    are not used. What comes to the driver are sums for each membership pattern and source (patterns of up to all sources, as many as there are). The corpus aimed at has ``total_tokens``, by default those of all documents together.
    Returns (id, ``source``, ``tokens``, ``uses``) for documents used at least once, and per target source
    ``target_share``, ``capacity_tokens``, ``quota_tokens``, ``tokens`` used, ``actual_share``, ``reachable``.
    """
    goals = {r["source"].strip().lower(): (r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()}
    docs = settled(sizes.select(id_col, F.lower(F.trim(source_col)).alias("source"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col(digest_col).alias("digest")))
    total = float(total_tokens if total_tokens is not None else docs.agg(F.sum("tokens")).first()[0] or 0)
    known = docs.where(F.col("source").isin(list(goals)) & (F.col("tokens") > 0))
    # A text's copies: only their sources and one size are gathered, never their rows.
    members = known.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("pattern"), F.max("tokens").alias("once"))
    joined = settled(known.join(members, "digest").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(BUCKETS)).cast("int")))
    distinct = {r["pattern"]: float(r["t"]) for r in members.groupBy("pattern").agg(F.sum("once").alias("t")).toLocalIterator()}
    held = joined.groupBy("pattern", "source", "bucket").agg(F.sum("tokens").alias("t"))
    holdings = {(r["pattern"], r["source"]): float(r["t"]) for r in held.groupBy("pattern", "source").agg(F.sum("t").alias("t")).collect()}
    quotas = {s: share * total for s, (_, share, _) in goals.items()}
    repeats = {s: n for s, (_, _, n) in goals.items()}
    flow = routed(holdings, distinct, quotas, repeats)
    spark = sizes.sparkSession
    given = []
    for (p, s), t in holdings.items():
        whole, rest = divmod(flow[p, s], t)
        given.append((p, s, int(whole), float(rest)))
    goal = spark.createDataFrame(given, "pattern string, source string, whole int, rest double")
    # the last, partial use takes buckets in order, as many as come nearest to the rest
    upon = Window.partitionBy("pattern", "source").orderBy("bucket")
    taken = held.join(goal.where("rest > 1e-6"), ["pattern", "source"]).withColumn("before", F.sum("t").over(upon) - F.col("t")).where("before + t / 2 <= rest")
    upto = taken.groupBy("pattern", "source").agg(F.max(F.col("bucket") + 1).alias("upto"))
    levels = goal.drop("rest").join(upto, ["pattern", "source"], "left").fillna(0, ["upto"])
    most = F.create_map(*[F.lit(x) for s, n in repeats.items() for x in (s, n)]) if repeats else F.create_map(F.lit(""), F.lit(0))
    uses = F.least(F.col("whole") + F.when(F.col("bucket") < F.col("upto"), 1).otherwise(0), most[F.col("source")])
    used = settled(joined.join(levels, ["pattern", "source"]).withColumn("uses", uses).where("uses > 0").select(id_col, "source", "tokens", "uses"))
    sums = {r["source"]: float(r["t"]) for r in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t")).collect()}
    capacity = {s: sum(t for (_, q), t in holdings.items() if q == s) * repeats[s] for s in goals}
    all_used = sum(sums.values()) or 1.0
    reached = {s: sum(f for (_, q), f in flow.items() if q == s) for s in goals}
    report = [
        (name, share, int(capacity[s]), quotas[s], int(sums.get(s, 0)), round(sums.get(s, 0.0) / all_used, 6), reached[s] >= quotas[s] - max(1e-3, 1e-9 * total))
        for s, (name, share, _) in sorted(goals.items())
    ]
    schema = "source string, target_share double, capacity_tokens long, quota_tokens double, tokens long, actual_share double, reachable boolean"
    return used, spark.createDataFrame(report, schema)
