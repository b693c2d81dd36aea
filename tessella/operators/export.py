"""Wide tables for reports: documents and fragments by category, batch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import profile


def _by_place() -> list[tuple[str, str]]:
    """(name, short name) in the order of exported sheets."""
    return [(f"{c[0]}Intelligence", c[0]) for c in sorted(dims.CATEGORIES, key=lambda c: c[5])]


def primary_rows(acts: DataFrame) -> DataFrame:
    """Activations with ``is_primary``: by link, and where a fragment has no primary link by type."""
    linked = acts.groupBy("doc_id", "k").agg(F.max("is_primary_link").alias("has_link"))
    return acts.join(linked, ["doc_id", "k"]).withColumn("is_primary", F.when(F.col("has_link"), F.col("is_primary_link")).otherwise(F.col("atype") == "Primary"))


def document_sheet(acts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document its leading category, its vector, and in how many fragments each category is primary or a linked secondary.

    Activations are one row for each (doc_id, k, category), so fragments are counted without looking for distinct ones.
    """
    counts = primary_rows(acts).groupBy("doc_id").agg(
        *[F.count_if((F.col("category") == name) & F.col("is_primary")).alias(f"{short}_primary") for name, short in _by_place()],
        *[F.count_if((F.col("category") == name) & F.col("is_secondary_link")).alias(f"{short}_secondary") for name, short in _by_place()],
    )
    lead = profile.top_category(vectors)
    return vectors.select("doc_id", lead.alias("leading"), *[F.col(s).cast("double").alias(s) for _, s in _by_place()]).join(counts, "doc_id", "left")


def fragment_sheet(acts: DataFrame) -> DataFrame:
    """Per fragment the highest primary and linked secondary score of each category; 0 where a score is missing, null where there is no activation."""
    score = F.coalesce(F.col("share").cast("double"), F.lit(0.0))
    return primary_rows(acts).groupBy("doc_id", "k").agg(
        *[F.max(F.when((F.col("category") == name) & F.col("is_primary"), score)).alias(f"{short}_primary") for name, short in _by_place()],
        *[F.max(F.when((F.col("category") == name) & F.col("is_secondary_link"), score)).alias(f"{short}_secondary") for name, short in _by_place()],
    )


def batch_rows(vectors: DataFrame) -> DataFrame:
    """Per document its leading category (ties in index order) and which categories are active."""
    return vectors.select("doc_id", profile.top_category(vectors, 3).alias("leading"), *[(F.col(s) > 0).alias(f"{s}_active") for s in dims.SHORT])
