import itertools
import random
import time

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella import shared
from tessella.llm import clusters, mixing, neighbours, packing, tokens, vectors

SCHEMA = "doc_id string, vector array<double>, note string"


def loaded(spark, arrays):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in arrays], SCHEMA)


def planted(seed=0):
    """Background vectors, tight groups on different scales, a group with a close outsider, a group too wide, a group too small."""
    rng = np.random.default_rng(seed)
    data, groups = [], {}

    def near(c, n, spread):
        out = np.abs(c + rng.normal(0, spread, (n, 8)))
        return out * rng.choice([1, 100, 0.3], (n, 1))

    # Centres well apart from each other and from everything else.
    corners = [np.eye(8)[i] + 0.05 for i in range(8)]
    for g, (n, spread) in enumerate([(60, 0.003), (25, 0.006), (20, 0.001), (19, 0.001)]):
        ids = [f"g{g}-{i:03}" for i in range(n)]
        data += list(zip(ids, near(corners[g], n, spread)))
        if n >= 20:
            groups[min(ids)] = set(ids)
    data += [(f"h{i}", v) for i, v in enumerate(near(corners[4], 30, 0.002))] + [("h-out", corners[4] + np.array([0, 0.12, 0, 0, 0, 0, 0, 0.0]))]
    data += [(f"w{i}", v) for i, v in enumerate(near(corners[5], 40, 0.05))]
    middle = rng.dirichlet(np.ones(8) * 8, 400)
    data += [(f"b{i:03}", v) for i, v in enumerate(middle)]
    return data, groups


def brute_groups(data):
    ids = [i for i, _ in data]
    u = np.stack([v for _, v in data])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    found = {}
    for i in range(len(u)):
        inside = np.flatnonzero(s[i] >= clusters.GROUP)
        outside = np.flatnonzero(s[i] < clusters.GROUP)
        if len(inside) >= clusters.LEAST and s[np.ix_(inside, inside)].min() >= clusters.GROUP and s[np.ix_(inside, outside)].max() < clusters.APART:
            found[min(ids[j] for j in inside)] = {ids[j] for j in inside}
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_as_brute_force(spark, seed):
    data, groups = planted(seed)
    assert brute_groups(data) == groups
    bad = [("n", None), ("z", [0.0] * 8), ("s", [1.0] * 7), ("m", [1, -1, 0, 0, 0, 0, 0, 0]), ("i", [float("inf")] + [1.0] * 7), ("q", [float("nan")] * 8), (None, [1.0] * 8)]
    df = loaded(spark, data + data[:9] + bad)
    docs, members = clusters.clustered(df)
    got = {}
    for r in clusters.tight_groups(docs, members).collect():
        got.setdefault(r["group_key"], set()).add(r["doc_id"])
    assert got == groups
    assert docs.count() == len(data) and members.agg(F.sum("n")).first()[0] == len(data)
    told = clusters.described(docs, members)
    assert told.agg(F.sum("size")).first()[0] == len(data) and told.where("typical_1 IS NULL").count() == 0


def test_groups_in_tiny_batches(spark):
    """Rows that come one at a time, in many partitions, some of them empty, give the same groups."""
    data, groups = planted(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        docs, members = clusters.clustered(loaded(spark, data).repartition(7).unionByName(loaded(spark, data).limit(0)))
        got = {}
        for r in clusters.tight_groups(docs, members).collect():
            got.setdefault(r["group_key"], set()).add(r["doc_id"])
        assert got == groups
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_of_empty_and_equal_tables(spark):
    docs, members = clusters.clustered(loaded(spark, [("a", None)]))
    assert clusters.tight_groups(docs, members).count() == 0
    docs, members = clusters.clustered(loaded(spark, [(f"a{i:02}", [1, 2, 3, 4, 5, 6, 7, 8]) for i in range(25)]))
    assert rows(clusters.tight_groups(docs, members).groupBy("group_key").count()) == [("a00", 25)]


def test_markov_clusters_split_a_bridge(spark):
    """Two cliques joined by one weak link are two clusters; plain numpy gives the same."""
    edges = [(a, b, 1.0) for group in (range(1, 6), range(6, 11)) for a, b in itertools.permutations(group, 2)] + [(5, 6, 0.1), (6, 5, 0.1)]
    edges += [(i, i, 1.0) for i in range(1, 12)]
    m = np.zeros((11, 11))
    for a, b, w in edges:
        m[b - 1, a - 1] = w
    m /= m.sum(axis=0)
    for _ in range(12):
        m = np.power(m @ m, 2)
        m /= m.sum(axis=0)
    links = clusters.stochastic(spark.createDataFrame([(a, b, w) for a, b, w in edges], "src long, dst long, w double"), 0.0).drop("k")
    got = {}
    for r in clusters.markov_clusters(links, least=1e-4).collect():
        got.setdefault(r["cluster"], set()).add(r["cell"])
    assert all(c in members for c, members in got.items())
    assert sorted(map(sorted, got.values())) == [list(range(1, 6)), list(range(6, 11)), [11]]
    assert {tuple(np.flatnonzero(m[:, j] > 0.01) < 5) for j in range(5)} <= {(True,) * n for n in range(1, 6)}


@pytest.mark.parametrize("seed", [0, 1])
def test_dense_clusters_as_unpruned_matrix(spark, seed):
    """Where cells have dozens of similar ones, the flows are those of the whole threshold graph and the clusters those of plain numpy."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([np.abs(c + rng.normal(0, 0.02, (120, 8))) for c in (np.eye(8) + 0.3)[:3]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n = len(points)
    cells = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(points)], "cell long, n long, m array<double>")
    links, reach = clusters.links_of(cells)
    links = links.collect()
    linked = points @ points.T >= clusters.SIMILAR
    assert np.percentile(linked.sum(axis=0), 75) > 20
    assert {r["cell"]: r["reach"] for r in reach.collect()} == dict(enumerate(linked.sum(axis=0).tolist()))
    whole = clusters.links_of(cells, least=0.0)[0]
    assert {(r["src"], r["dst"]) for r in whole.collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(linked | np.eye(n, dtype=bool)))))
    m = np.zeros((n, n))
    for r in whole.collect():
        m[r["dst"], r["src"]] = r["w"]
    for _ in range(20):
        m = np.power(m @ m, 2)
        m /= m.sum(axis=0)
    end = m.argmax(axis=0)
    got = {r["cell"]: r["cluster"] for r in clusters.markov_clusters(clusters.links_of(cells)[0]).collect()}
    assert np.mean([got[i] == end[i] for i in range(n)]) > 0.98


def test_pointers_end(spark):
    at = [(1, 2), (2, 3), (3, 4), (4, 4), (5, 6), (6, 5), (7, 6)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in at], "src long, dst long, w double")
    assert rows(clusters.followed(df), "src", "dst") == [(1, 4), (2, 4), (3, 4), (4, 4), (5, 5), (6, 5), (7, 5)]


def test_links_are_all_found(spark):
    rng = np.random.default_rng(3)
    docs = vectors.directions(loaded(spark, [(f"d{i}", v) for i, v in enumerate(rng.dirichlet(np.ones(8) * 30, 600))])).withColumn("cell", clusters.cell_of(F.col("u")))
    cells = clusters.cells_of(docs).toPandas()
    m = np.stack(cells["m"].to_numpy())
    s = m @ m.T
    want = {(cells["cell"][i], cells["cell"][j]) for i, j in zip(*np.nonzero(s >= 0.998))}
    assert {(i, j) for i, j, _ in ((i, j, c) for part in clusters.near_pairs(m, 0.998, 30) for i, j, c in zip(*part))} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.998)) if i != j}
    frame = spark.createDataFrame(cells)
    got = clusters.links_of(frame, least=0.0, tree=clusters.tree_for(frame, leaf_size=40))[0].collect()
    assert {(r["src"], r["dst"]) for r in got} == want | {(c, c) for c in cells["cell"]}


def test_columns_squared_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    flows = [(int(a), int(b), float(w)) for a in range(60) for b, w in zip(rng.choice(60, 6, replace=False), rng.random(6) + 0.1)]
    links = clusters.stochastic(spark.createDataFrame([f for f in flows if f[0] != f[1]] + [(a, a, 0.5) for a in range(60)], "src long, dst long, w double")).drop("k").cache()
    at_once = rows(clusters.markov_clusters(links), "cell", "cluster")
    monkeypatch.setattr(clusters, "MANY", 0)
    monkeypatch.setattr(clusters, "TURNS", 3)
    assert rows(clusters.markov_clusters(links), "cell", "cluster") == at_once and len(at_once) == 60


def test_settled_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}

    before, set_to = files(), spark.conf.get(shared.CLEANUP, None)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("n")).orderBy("n")
    out = shared.settled(df)
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.5)
    assert not files() - before
    assert spark.conf.get(shared.CLEANUP, None) == set_to
    assert out.count() == 700 and rows(out) == rows(df)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    data = [(f"d{i:04}", v * rng.choice([1.0, 50.0])) for i, v in enumerate(rng.dirichlet(np.ones(8), 3000))] + [(f"e{i}", [1.0] * 8) for i in range(3)]
    docs = vectors.directions(loaded(spark, data + [("bad", None)]))
    asked = [f"d{i:04}" for i in range(0, 3000, 100)] + ["e1"]
    got = neighbours.nearest(docs, docs.where(F.col("doc_id").isin(asked)), k=10).collect()
    u = np.stack([v for _, v in data])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    ids = [i for i, _ in data]
    hits = 0
    for q in asked:
        s = u @ u[ids.index(q)]
        best = [ids[j] for j in np.lexsort((ids, -np.round(s, 14))) if ids[j] != q][:10]
        mine = [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hits += len(set(best) & set(mine))
        assert len(mine) == 10 and q not in mine
    assert hits / (10 * len(asked)) >= 0.97
    few = vectors.directions(loaded(spark, [("a", [1.0] * 8), ("b", [2.0] * 8)]))
    assert rows(neighbours.unordered(neighbours.nearest(few, few))) == [("a", "b")]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_are_complete_whatever_is_ranked_first(spark, monkeypatch):
    """Few candidates, small shares, dense regions and equal vectors: no list that holds a neighbour is left out."""
    monkeypatch.setattr(neighbours, "SHARE", 40)
    rng = np.random.default_rng(9)
    u = np.concatenate([rng.dirichlet(np.ones(8), 1200), rng.dirichlet(np.ones(8) * 4000, 300), np.repeat(rng.dirichlet(np.ones(8), 1), 60, axis=0)])
    ids = [f"d{i:05}" for i in rng.permutation(len(u))]
    docs = vectors.directions(loaded(spark, list(zip(ids, u)))).cache()
    asked = ids[::40]
    got = neighbours.nearest(docs, docs.where(F.col("doc_id").isin(asked)), candidates=15, sample=400, pivots=40).collect()
    x = {r["doc_id"]: np.array(r["u"]) for r in docs.collect()}
    names = sorted(x)
    m = np.stack([x[n] for n in names])
    want = set()
    for q in asked:
        s = neighbours.cosines(m, np.broadcast_to(x[q], m.shape))
        want |= {(q, names[j], r + 1) for r, j in enumerate([j for j in np.argsort(-s, kind="stable") if names[j] != q][:10])}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == want
    assert neighbours.nearest(docs, docs.limit(0)).count() == 0


def test_footrule(spark):
    """A gain is the largest distance less the footrule distance of the two prefixes, halved."""
    rng = np.random.default_rng(2)
    x, marks = rng.random((50, 8)), rng.random((20, 8))
    x, marks = x / np.linalg.norm(x, axis=1, keepdims=True), marks / np.linalg.norm(marks, axis=1, keepdims=True)
    post, order = neighbours.Postings(x, marks, 5), neighbours.orders(x, marks, 5)
    for q in range(10):
        gains = post.gains(order[q])
        for i in range(50):
            a, b = list(order[q]), list(order[i])
            distance = sum(abs((a.index(p) if p in a else 5) - (b.index(p) if p in b else 5)) for p in set(a) | set(b))
            assert 2 * int(gains[i]) == 5 * 6 - distance


def test_tokens(spark):
    df = spark.createDataFrame([(1, "um texto de exemplo", "x"), (2, None, "x"), (3, "", "x")], "id long, text string, tokens string")
    got = {r["id"]: r["tokens"] for r in tokens.with_tokens(df).collect()}
    assert got == {1: tokens.token_count("um texto de exemplo"), 2: 0, 3: 0} and got[1] >= 4


@pytest.mark.parametrize("capacity,seed", [(100, 0), (37, 1)])
def test_packing(spark, capacity, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, capacity // 3), rng.randint(1, capacity), 7]) for _ in range(500)] + [capacity, 2 * capacity + 5, 0, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, tokens long")
    placed = packing.packed(df.withColumn("size", F.lit("clash")), "id", capacity).collect()
    held = {}
    for r in placed:
        held.setdefault(r["container_no"], []).append(r["size"])
    assert all(sum(v) <= capacity for v in held.values())
    by = {}
    for r in placed:
        by[r["id"]] = by.get(r["id"], 0) + r["size"]
    assert by == {i: s for i, s in enumerate(sizes) if s}
    total = sum(s for s in sizes if s)
    assert len(held) <= -(-total // capacity) * 1.03 + 1 and set(held) == set(range(len(held)))
    assert rows(packing.oversized(df, "id", capacity)) == [(501,)]
    assert packing.packed(df.limit(0), "id", capacity).count() == 0


def test_exact_fill():
    stock = np.zeros(101, dtype=np.int64)
    stock[[30, 33, 37, 50]] = 1
    assert packing.exact_fill(stock, 50) == [50] and packing.exact_fill(stock, 70) == [37, 33] and sorted(packing.exact_fill(stock, 100)) == [30, 33, 37]
    assert packing.exact_fill(stock, 60) is None and packing.exact_fill(stock, 99) is None


def test_mixing(spark):
    docs = [(i, " A " if i % 2 else "a", 10, f"a{i}") for i in range(100)] + [(1000 + i, "b", 10, f"b{i}") for i in range(10)] + [(2000 + i, "c", 10, f"a{i}") for i in range(50)] + [(3000, None, 10, "n"), (3001, "z", 70, "z"), (3002, "a", None, "q")]
    df = spark.createDataFrame(docs, "id long, source string, tokens long, digest string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.2, 2), ("c", 0.2, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    used, report = mixing.mixed(df, targets, "id")
    total = sum(t or 0 for _, _, t, _ in docs)
    by = {r["source"]: r for r in report.collect()}
    assert [s for s in sorted(by) if not by[s]["reachable"]] == ["B", "none"]
    assert by["B"]["tokens"] == 200 and abs(by["a"]["tokens"] - 0.5 * total) <= 20 and abs(by["c"]["tokens"] - 0.2 * total) <= 20
    assert used.where("uses > 3 OR uses < 1").count() == 0 and used.where("source = 'b' AND uses <> 2").count() == 0
    assert rows(mixing.mixed(df, targets, "id")[0]) == rows(used)
    none, empty = mixing.mixed(df.limit(0), targets, "id")
    assert none.count() == 0 and empty.count() == 4


def test_flow_prefers_unused_texts():
    """A text held by two sources is given once before anything is given twice."""
    flow = mixing.routed({("a", "a"): 10.0, ("a|b", "a"): 10.0, ("a|b", "b"): 10.0}, {"a": 10.0, "a|b": 10.0}, {"a": 10.0, "b": 10.0}, {"a": 2, "b": 2})
    assert flow["a", "a"] == pytest.approx(10) and flow["a|b", "b"] == pytest.approx(10) and flow["a|b", "a"] == pytest.approx(0)
