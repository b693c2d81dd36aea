"""Helpers shared by all operators: table access, lineage cuts, partition sizes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where a session on one machine has none (tests) a folder of
    our own is set. On a cluster without one it is an error, as a machine's own folder would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = os.path.join(tempfile.gettempdir(), f"tessella-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(known)
    return known


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (replicated storage, not executor memory) and cut its lineage.

    Its shuffle files are deleted at once, as nothing reads them again. Spark deletes checkpoints that nothing refers to only when the driver collects its garbage, which a
    large heap may never do within a query; so it is asked to, else the files of all rounds of an iteration pile up.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.select("*").checkpoint(eager=True)  # a plan of its own: it takes the setting when it is made, and ``df`` itself may be run again
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all slots if it has fewer partitions, as a few small files otherwise leave cores idle in
    CPU-bound stages. A large table has more partitions than slots and isn't moved."""
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, in case their path lacks it."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="tessella-code-")) / "tessella_code.zip"  # the driver's own; the file server hands it to executors
    target.write_bytes(held.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
