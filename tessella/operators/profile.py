"""Profile vectors of fragments and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import numbers as N
from ..functions import text as T


def _sums(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """A column per category with the sum of its values: a pivot of known values, in one aggregate."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("category") == name, value)), F.lit(0).cast("decimal(18,4)")).cast("double").alias(short) for name, short in zip(dims.NAMES, dims.SHORT, strict=True)])


def _finished(sums: DataFrame, keys: list[str], norm: str, tau: float) -> DataFrame:
    values = N.normalised([F.col(s) for s in dims.SHORT], norm, tau)
    named = sums.select(*keys, *[v.alias(s) for v, s in zip(values, dims.SHORT, strict=True)])
    return named.select(*keys, *[N.half_up(F.col(s)).alias(s) for s in dims.SHORT], F.concat_ws(",", *[N.percent_text(F.col(s)) for s in dims.SHORT]).alias("mi_vector"))


def fragment_vectors(acts: DataFrame, norm: str = "l1", tau: float = 1.0) -> DataFrame:
    """A vector per fragment with activations: shares summed per category and normalised, as eight decimals and as percent text."""
    return _finished(_sums(acts, ["doc_id", "k"], F.col("share")), ["doc_id", "k"], norm, tau)


def document_vectors(acts: DataFrame, fragments: DataFrame, norm: str = "l1", tau: float = 1.0, alpha_title: float = 1.3, alpha_body: float = 1.0) -> DataFrame:
    """A vector per document with activations: shares weighted by ``alpha_title`` in titles and abstracts and ``alpha_body`` elsewhere.

    A fragment without a flag counts as body.
    """
    flags = fragments.select("doc_id", "k", "is_title")
    alpha = F.when(F.coalesce("is_title", F.lit(False)), F.lit(alpha_title)).otherwise(F.lit(alpha_body)).cast("decimal(6,2)")
    rows = acts.join(flags, ["doc_id", "k"], "left").withColumn("weighted", (F.col("share") * alpha).cast("decimal(18,6)"))
    return _finished(_sums(rows, ["doc_id"], F.col("weighted")), ["doc_id"], norm, tau)


def profile_vectors(acts: DataFrame, fragments: DataFrame, scope: str = "both", **options) -> DataFrame:
    """Vectors of documents, fragments or both, with their scope and URI."""
    parts = []
    if scope in ("document", "both"):
        docs = document_vectors(acts, fragments, **options)
        parts.append(docs.select("doc_id", F.lit("document").alias("scope"), F.lit(None).cast("int").alias("k"), F.concat(T.base_of(F.col("doc_id")), F.lit("vec-doc")).alias("vec_uri"), *dims.SHORT, "mi_vector"))
    if scope in ("fragment", "both"):
        options = {o: v for o, v in options.items() if not o.startswith("alpha")}
        frags = fragment_vectors(acts, **options)
        parts.append(frags.select("doc_id", F.lit("fragment").alias("scope"), "k", F.concat(T.base_of(F.col("doc_id")), F.format_string("vec-frag-%03d", F.col("k"))).alias("vec_uri"), *dims.SHORT, "mi_vector"))
    if not parts:
        raise ValueError(f"unknown scope {scope}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def long_form(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One row per vector and category."""
    pairs = ", ".join(f"'{name}', cast(`{short}` as double)" for name, short in zip(dims.NAMES, dims.SHORT, strict=True))
    return vectors.selectExpr(*keys, f"stack(8, {pairs}) as (category, value)")


def completed(vectors: DataFrame) -> DataFrame:
    """Missing numbers of vectors filled from their percent text."""
    parsed = N.parsed_vector(F.col("mi_vector"))
    return vectors.select(*[c for c in vectors.columns if c not in dims.SHORT], *[F.coalesce(F.col(s).cast("double"), F.get(parsed, F.lit(i)) / 100).alias(s) for i, s in enumerate(dims.SHORT)])


def top_category(vectors: DataFrame, order: int = 5) -> Column:
    """The category of a vector's largest number if it is above 0; ties by the given order of categories (5: of exported sheets, 3: of category lists)."""
    ranked = sorted(zip(dims.CATEGORIES, dims.SHORT, strict=True), key=lambda c: c[0][order])
    most = F.greatest(*[F.col(s) for s in dims.SHORT])
    out = F.when(most <= 0, F.lit(None).cast("string"))
    for c, s in ranked:
        out = out.when(F.col(s) == most, f"{c[0]}Intelligence")
    return out
