"""Runs over many documents: logs, reports, what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_log(docs: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Per document its status and the number of its records that were set aside."""
    bad = quarantined.groupBy("doc_id").agg(F.count("*").alias("set_aside"))
    return docs.join(bad, "doc_id", "left").select("doc_id", F.coalesce("set_aside", F.lit(0)).alias("set_aside"), F.when(F.coalesce("set_aside", F.lit(0)) == 0, "success").otherwise("partial").alias("status"))


def report(log: DataFrame) -> DataFrame:
    """Counts of documents by outcome."""
    return log.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") != "success").alias("failures"))


def exit_code(log: DataFrame) -> int:
    """0 if every document succeeded, else 2."""
    return 0 if log.where("status <> 'success'").isEmpty() else 2
