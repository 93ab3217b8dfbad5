"""Tables of whole-number partitions that are replaced by publishing a version.

A version writes the partitions it replaces to a folder of its own, then one small manifest file that names the folder of every
partition. Readers take the last manifest, so they see the table before or after a version, never between: a writer that
fails in the middle leaves files that no manifest names. One writer at a time is assumed; folders that no recent manifest
names may be removed by the owner of the store.

Layout: ``path/data/folder=<version>-<id>/<column>=<value>/…`` and ``path/manifest``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

MANIFEST = "version bigint, column string, value bigint, folder string, schema string"


def _manifest(spark: SparkSession, path: str) -> list:
    """Rows of the last manifest: one a partition, and one without a value that names the schema."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    last = rows.agg(F.max("version").alias("v")).first().v
    return rows.filter(F.col("version") == last).collect() if last is not None else []


def version(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each partition in the last version."""
    return {r.value: r.folder for r in _manifest(spark, path) if r.value is not None}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version; null before the first. Only partitions in it are listed."""
    rows = _manifest(spark, path)
    if not rows:
        return None
    schema = T.StructType.fromJson(json.loads(rows[0].schema))
    folders = [f"{path}/data/folder={r.folder}/{r.column}={r.value}" for r in rows if r.value is not None]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def publish(rows: DataFrame, path: str, column: str, replaces: Callable[[int], bool]) -> None:
    """Put ``rows``, partitioned by a whole-number ``column``, in place of the partitions that ``replaces`` accepts.

    Partitions that get no rows leave the table. The driver handles one row a partition.
    """
    spark = rows.sparkSession
    before = _manifest(spark, path)
    number = max((r.version for r in before), default=0) + 1
    folder = f"{number}-{uuid.uuid4().hex[:8]}"
    kept = {r.value: r.folder for r in before if r.value is not None and not replaces(r.value)}
    rows.write.partitionBy(column).parquet(f"{path}/data/folder={folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/folder={folder}").select(F.col(column).cast("bigint").alias("v")).distinct().collect()
    kept.update({r.v: folder for r in written})
    schema = rows.schema.json()
    entries = [(number, column, None, None, schema)] + [(number, column, v, f, schema) for v, f in sorted(kept.items())]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
