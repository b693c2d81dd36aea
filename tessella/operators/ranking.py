"""Ranking of documents against profiles, and measures of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import numbers as N


def chosen_profiles(profiles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The named profiles; none or ['all'] names all, blank keys are skipped, unknown ones raise ``KeyError``."""
    wanted = [k.strip() for k in keys or [] if k and k.strip()]
    if not wanted or wanted == ["all"]:
        return profiles
    known = {r["key"] for r in profiles.select("key").collect()}  # a table of reference profiles is small by its nature
    if missing := [k for k in wanted if k not in known]:
        raise KeyError(f"unknown profiles: {', '.join(missing)}")
    return profiles.where(F.col("key").isin(wanted))


def valid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with their numbers divided by their sum. One that has not eight finite numbers, has a negative one or sums to nothing raises an error that names it."""
    v = F.col("vector")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    fine = F.coalesce((F.size(v) == 8) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf")))) & (total > 0), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no valid profile: "), F.coalesce("key", F.lit("(no key)"))))
    return profiles.withColumn("vector", F.when(fine, F.transform(v, lambda x: x / total)).otherwise(wrong.cast("array<double>")))


def latest_vectors(loaded: DataFrame) -> DataFrame:
    """One vector per document of those with eight numbers: the one loaded last, ties by a hash of the vector.

    The numbers are aggregated as single columns by one whole number, for which Spark hashes instead of sorting.
    """
    good = loaded.where((F.size("vector") == 8) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    order = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)) * 1024 + F.pmod(F.xxhash64("vector"), F.lit(1024))
    wide = good.select("doc_id", order.alias("_o"), *[F.col("vector")[i].alias(f"_{i}") for i in range(8)])
    one = wide.groupBy("doc_id").agg(*[F.max_by(f"_{i}", "_o").alias(f"_{i}") for i in range(8)])
    return one.select("doc_id", F.array(*[f"_{i}" for i in range(8)]).alias("vector"))


def scored(vectors: DataFrame, profiles: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """(key, doc_id, score): the cosine of every document with every profile (a small table), over all or only the ``focus`` categories.

    A vector without length scores 0. Profiles are a table whose size Catalyst knows; no document is compared with another.
    """
    return scored_by(vectors, profiles, score=focus)


def scored_by(vectors: DataFrame, profiles: DataFrame, **scores: list[str] | None) -> DataFrame:
    """``scored`` with a column for each named focus, so that several views of the same pairs need one pass."""
    pairs = vectors.select("doc_id", "vector").crossJoin(profiles.select("key", F.col("vector").alias("profile")))
    columns = []
    for name, focus in scores.items():
        places = [i for i, n in enumerate(dims.SHORT) if not focus or n in focus or f"{n}Intelligence" in focus]
        if not places:
            raise ValueError("no category in focus")
        a, b = [F.get("vector", F.lit(i)) for i in places], [F.get("profile", F.lit(i)) for i in places]
        columns.append(F.round(N.cosine(a, b), 9).alias(name))
    return pairs.select("key", "doc_id", *columns)


def ranked(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``max(1, k)`` best documents of each profile, ties by id. Spark limits each partition's groups before the shuffle."""
    per = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("place", F.row_number().over(per)).where(F.col("place") <= max(1, int(k)))


def like_document(vectors: DataFrame, doc_id: str | None = None, k: int = 10) -> DataFrame:
    """The documents most similar to one of them (itself included); without or with an unknown id, to the first by id."""
    first = vectors.agg(F.coalesce(F.min(F.when(F.col("doc_id") == doc_id, F.col("doc_id"))) if doc_id else F.lit(None), F.min("doc_id")).alias("doc_id"))
    query = vectors.join(first, "doc_id").limit(1).select(F.col("doc_id").alias("key"), "vector")
    return ranked(scored(vectors, query), k)


def sanity(vectors: DataFrame) -> DataFrame:
    """Vectors of another size than eight, and those that sum to nothing."""
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return vectors.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.size("vector") != 8, F.lit(True))).alias("wrong_size"), F.count_if(F.coalesce(total <= 0, F.lit(True))).alias("no_sum"))


def average_ranks(df: DataFrame, value: str, name: str, bins: int = 4096) -> DataFrame:
    """``df`` with the average rank (the highest value first) of each row within its ``key``.

    Counts per distinct value are cut into bins of value; the bins' counts (at most ``bins`` a key) are summed in a window, and ranks within
    a bin in another, so no task sorts a whole key.
    """
    counts = df.groupBy("key", value).agg(F.count("*").alias("n"))
    ends = df.groupBy("key").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    binned = counts.join(ends, "key").withColumn("bin", F.least(F.lit(bins - 1), F.floor(width * bins)).cast("int")).select("key", value, "n", "bin")
    per_bin = binned.groupBy("key", "bin").agg(F.sum("n").alias("m"))
    above = per_bin.withColumn("above", F.sum("m").over(Window.partitionBy("key").orderBy(F.desc("bin"))) - F.col("m")).select("key", "bin", "above")
    inside = F.sum("n").over(Window.partitionBy("key", "bin").orderBy(F.desc(value)))
    placed = binned.join(above, ["key", "bin"]).select("key", value, (F.col("above") + inside - (F.col("n") - 1) / 2.0).alias(name))
    return df.join(placed, ["key", value])


def rank_correlation(scores: DataFrame, one: str, other: str) -> DataFrame:
    """Spearman's correlation of two score columns per ``key``: Pearson's of average ranks. Both scores stand in one row, so the tables never join each other."""
    both = average_ranks(average_ranks(scores, one, "_a"), other, "_b")
    return both.groupBy("key").agg(F.round(F.corr("_a", "_b"), 6).alias("spearman"), F.count("*").alias("n"))


def f1_micro(predicted: Column, actual: Column) -> Column:
    """Micro-averaged F1 of single labels: the share of right ones."""
    return F.round(F.count_if(predicted == actual) / F.count("*"), 6)


def vector_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cosine and Euclidean distance between two versions of each document's vector."""
    joined = before.select("doc_id", F.col("vector").alias("a")).join(after.select("doc_id", F.col("vector").alias("b")), "doc_id")
    a, b = N.at(F.col("a")), N.at(F.col("b"))
    gap = sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))
    return joined.select("doc_id", F.round(N.cosine(a, b), 9).alias("cosine"), F.round(F.sqrt(gap), 9).alias("distance"))


def first_documents(vectors: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by id, all if ``n`` is not above 0."""
    return vectors.orderBy("doc_id").limit(n) if n > 0 else vectors
