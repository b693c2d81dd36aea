"""New text files as a stream, through the same stateless transformations as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import ingest


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of text files as they arrive."""
    rows = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder).withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.substring_index(F.url_decode("path"), "/", -1), r"\.[^.]*$", "")
    return rows.select(F.concat(F.lit("urn:doc:"), X.slug(name)).alias("doc_id"), F.col("value").alias("text"))


def fragment_stream(docs: DataFrame, max_chars: int = 900, min_chars: int = 120) -> DataFrame:
    """Fragments of a stream of documents."""
    return ingest.exploded(ingest.resegmented(ingest.from_text(docs, "doc_id", "text"), max_chars, min_chars))


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All files there now, in batches that a restart doesn't repeat."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_arrivals(events: DataFrame, time_col: str, key_cols: list[str], late: str = "30 days") -> DataFrame:
    """Counts per day and key, with a watermark for late rows; on a table the watermark has no effect."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("day"), *key_cols).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), *key_cols, "n")
