"""Valid profile vectors: which they are, their directions, one per document."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 8


def is_valid(vector: Column, dims: int = DIMS) -> Column:
    """A valid vector has ``dims`` finite numbers, none negative, not all zero."""
    numbers = [F.get(vector, F.lit(i)) for i in range(dims)]  # one by one, as Spark generates no code for functions of arrays
    good = F.size(vector) == dims
    for x in numbers:
        good &= x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf")))
    return F.coalesce(good & reduce(operator.or_, [x > 0 for x in numbers]), F.lit(False))


def direction(vector: Column, dims: int = DIMS) -> Column:
    """The vector at length one, whatever scale it was stored on; scaled by its largest number first, so that nothing overflows."""
    numbers = [F.get(vector, F.lit(i)) for i in range(dims)]
    most = F.greatest(*numbers) if dims > 1 else numbers[0]
    scaled = [x / most for x in numbers]
    length = F.sqrt(sum((x * x for x in scaled), F.lit(0.0)))
    return F.array(*[x / length for x in scaled])


def directions(df: DataFrame, id_col: str = "doc_id", vector_col: str = "vector", dims: int = DIMS) -> DataFrame:
    """(id, ``u``): one direction per id that has a valid vector; of several vectors that of the smallest hash.

    The numbers are aggregated as single columns, for which Spark hashes; arrays would have to be sorted.
    """
    v = F.col(vector_col)
    rows = df.where(F.col(id_col).isNotNull() & is_valid(v, dims)).select(F.col(id_col).alias("doc_id"), F.xxhash64(v).alias("_h"), direction(v, dims).alias("_u"))
    wide = rows.select("doc_id", "_h", *[F.col("_u")[i].alias(f"_{i}") for i in range(dims)])
    one = wide.groupBy("doc_id").agg(*[F.min_by(f"_{i}", "_h").alias(f"_{i}") for i in range(dims)])
    return one.select("doc_id", F.array(*[f"_{i}" for i in range(dims)]).alias("u"))
