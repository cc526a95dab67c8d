"""Session helpers: shared scratch tables, package shipping, small checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that survives the loss of any executor.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_ROOT:
        _LOCAL_ROOT[sc.applicationId] = tempfile.mkdtemp(prefix="spotfield-")
    return _LOCAL_ROOT[sc.applicationId]


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once, in folders by the values of a column if one is named, and return a scan of it.

    Cuts lineage, and lets the planner see the true size of the table: a
    per-specimen scalar table then broadcasts only if its files are smaller
    than ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_root(spark)}/spotfield/{app}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the stage tables of this application; frames that read them are of no use afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/spotfield/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spotfield-zip-"), "spotfield.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def finite(column):
    """True for a value that is neither null, NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def require_columns(df: DataFrame, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}")
