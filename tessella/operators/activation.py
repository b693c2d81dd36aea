"""Scores of categories per fragment, and the activations they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

FRAGMENT = ["doc_id", "k"]


def scores(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """(doc_id, k, category, score) of resolved evidence: the sum of role weight, relevance and confidence; missing ones count 1.

    ``weighted=False`` takes role weights alone. Sums are rounded to nine places, so that their order leaves no trace.
    """
    one = F.lit(1.0)
    value = F.col("weight")
    if weighted:
        value = value * F.coalesce(F.col("relevance").try_cast("double"), one) * F.coalesce(F.col("confidence").try_cast("double"), one)
    used = rows.where("role_name IS NOT NULL AND category IS NOT NULL")
    return used.groupBy(*FRAGMENT, "category").agg(F.round(F.sum(value), 9).alias("score"))


def activations(scored: DataFrame, theta: float = 0.75) -> DataFrame:
    """An activation per positive score: its share of the fragment's scores, primary (the highest; ties by name) or secondary, and
    whether a secondary one is linked (at least ``theta`` of the highest).

    Null, zero and negative scores and unknown names give none; repeated keys are summed. One exchange serves all windows.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be above 0 and at most 1")
    rows = scored.where(F.col("score").isNotNull() & F.col("category").isNotNull()).groupBy(*FRAGMENT, "category").agg(F.round(F.sum("score"), 9).alias("score")).where("score > 0")
    per = Window.partitionBy(*FRAGMENT)
    top, whole = F.max("score").over(per), F.round(F.sum("score").over(per), 9)
    rank = F.row_number().over(per.orderBy(F.desc("score"), "category"))
    out = rows.select("*", N.half_up(F.col("score") / whole).alias("share"), N.half_up(F.col("score")).alias("weight"), rank.alias("rank"), (F.col("score") >= F.lit(theta) * top - 1e-12).alias("near"))
    return out.select(
        *FRAGMENT,
        F.concat(T.base_of(F.col("doc_id")), F.format_string("act-%03d-", F.col("k")), F.col("category")).alias("act_uri"),
        "category",
        "share",
        "weight",
        F.when(F.col("rank") == 1, "Primary").otherwise("Secondary").alias("atype"),
        (F.col("rank") == 1).alias("is_primary_link"),
        ((F.col("rank") > 1) & F.col("near")).alias("is_secondary_link"),
    )


def metrics(acts: DataFrame) -> DataFrame:
    """Counts of activations, primaries, secondaries and linked secondaries."""
    return acts.agg(
        F.count("*").alias("activations"),
        F.count_if("is_primary_link").alias("primaries"),
        F.greatest(F.lit(0), F.count("*") - F.count_if("is_primary_link")).alias("secondaries"),
        F.count_if("is_secondary_link").alias("linked_secondaries"),
    )
