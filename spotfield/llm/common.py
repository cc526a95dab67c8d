"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise, require_columns, ship_package  # noqa: F401

HOT_KEYS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, parts: int, part: int):
    """True where crc32 of the id as text, mod ``parts``, is ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which has one row per non-null ``key``; columns must not clash.

    The ``hot_keys`` largest groups by ``size`` are broadcast: that many rows at
    most, whatever the input.  Every other group holds less than one row in
    ``hot_keys`` of all, so a shuffled join deals the rest evenly.  A row of a hot
    group, or with a null key, takes a key of its own into the shuffled join and finds nothing there.
    """
    added = [c for c in groups.columns if c != key]
    hot = groups.orderBy(F.desc(size), key).limit(hot_keys)
    near = hot.select(F.col(key), F.struct(*added).alias("_hot"))
    out = rows.join(F.broadcast(near), key, "left")
    cold_key = F.when(F.col("_hot").isNull(), F.col(key))
    spread = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id())
    far = groups.select(F.col(key).alias("_cold_key"), F.lit(None).cast("long").alias("_spread"), F.struct(*added).alias("_cold"))
    out = out.withColumn("_k", cold_key).withColumn("_s", spread)
    joined = out.join(far, (F.col("_k") == F.col("_cold_key")) & F.col("_s").eqNullSafe(F.col("_spread")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *[found[c].alias(c) for c in added])


class Remembered(dict):
    """Results of ``make`` by key, about ``limit`` of them: what was not asked for while half as many others came goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


_LOADED: dict = {}


def loaded(kind, content: bytes):
    """``kind(content)``, kept by a Python worker from one task to the next; one of each kind."""
    held = _LOADED.get(kind)
    if held is None or held[0] != content:
        held = _LOADED[kind] = (content, kind(content))
    return held[1]
