"""Hashed character-trigram statistics of a whole corpus, and scores of texts under them.

The table has a fixed number of cells (``2 ** BITS``), whatever the corpus holds, so its
size on the driver and in every task is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
CELLS = 1 << BITS
#: Share of all trigrams at which a trigram is neither plausible nor implausible.
EVEN = 1e-6
#: A smaller corpus counts as one of so many trigrams, so that what occurs once or twice in it isn't plausible for that.
LEAST = 5_000_000
#: Tables of counts that a slot makes at most.
TABLES_A_SLOT = 4


def code_points(text: str) -> np.ndarray:
    """Code points, every digit alike."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes


def trigram_cells(codes: np.ndarray) -> np.ndarray:
    """The cell of each trigram; one per position from the third on."""
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= (codes[2:] + np.uint64(7)) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def corpus_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all trigram cells over every row's whole text.

    Partitions are read one after another by at most ``TABLES_A_SLOT`` tasks a slot, each of which counts into one table and sends at most ``CELLS`` pairs,
    so what is shuffled depends on the cluster's size, not on the corpus's; the sums come to the driver as one array of ``CELLS`` numbers.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            texts = batch.iloc[:, 0].tolist()
            for start in range(0, len(texts), 2000):
                joined = "\n".join(t for t in texts[start : start + 2000] if t)
                if joined:
                    total += np.bincount(trigram_cells(code_points(joined)), minlength=CELLS)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"cell": seen, "n": total[seen]})

    tables = TABLES_A_SLOT * df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.col(text_col).alias("t")).coalesce(tables).mapInPandas(count, "cell long, n long")
    summed = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[summed["cell"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.int64)
    return counts


def log_scores(counts: np.ndarray) -> np.ndarray:
    """Per cell, the log of the trigram's share against ``EVEN``; float32."""
    total = max(int(counts.sum()), LEAST)
    return np.log((counts + 0.05) / total / EVEN).astype(np.float32)


def score(text: str, table: np.ndarray) -> float:
    """Plausibility of a text: the sum of its trigrams' scores, blanks at both ends."""
    cells = trigram_cells(code_points(f" {text} "))
    return float(table[cells].sum())
