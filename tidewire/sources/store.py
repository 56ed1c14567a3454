"""The aggregate table on disk.

Layout: ``<path>/bucket_date=.../delta=<id>/*.parquet``.  A write only replaces its own delta of the dates it touches,
so replaying a batch with the same id leaves the table unchanged and no writer rewrites older rows.  Readers prune by
date; a read that needs one row per key merges the deltas.

``compact`` folds deltas into a new base and then commits a list of what the base replaces (``<path>/_commits``).
Readers skip replaced deltas and bases without a commit, so they see either the deltas or the base, whenever the job
stops; deltas that arrive meanwhile are on no list.  Replaced files go at the next run, when no reader plans with them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.labels import normalize_collector_id, normalize_collector_kind
from tidewire.functions.times import in_range, instant
from tidewire.params import UNKNOWN, check_retention

BASE = "base-"
COMMITS = "_commits"
ROWS_PER_FILE = 1_000_000


def merge_key(rows: DataFrame) -> DataFrame:
    """One row per key: bytes, packets and flows add up."""
    return rows.groupBy(*schemas.AGGREGATE_KEY).agg(
        *[F.sum(c).alias(c) for c in ("bytes", "packets", "flows")],
        F.to_date("bucket_ts").alias("bucket_date"),
    )


def write_aggregates(rows: DataFrame, path: str, batch_id: str, files: int = 1) -> None:
    """Add rows as one delta of ``files`` files a date; the same ``batch_id`` again replaces it."""
    (
        merge_key(rows)
        .withColumn("delta", F.lit(batch_id))
        .repartition(files, "bucket_date", F.pmod(F.xxhash64("src_ip"), F.lit(files)))
        .sortWithinPartitions("bucket_date", "src_ip", "bucket_ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date", "delta")
        .parquet(path)
    )


def files_for(rows: DataFrame) -> int:
    """Files for a stored or persisted frame, by its number of rows."""
    return max(1, -(-rows.count() // ROWS_PER_FILE))


def read_aggregates(
    spark: SparkSession, path: str, start=None, end=None, merge: bool = True
) -> DataFrame:
    """Rows of a range.  Sums and distinct counts do not need ``merge``."""
    rows = visible(spark.read.schema(schemas.FLOW_AGGREGATES + ", delta string").parquet(path), path)
    if start is not None:
        rows = in_range(rows, start, end)
    rows = rows.drop("delta")
    return merge_key(rows) if merge else rows


def _fs(spark: SparkSession, folder: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, folder: str) -> list[str]:
    fs, target = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _put(spark: SparkSession, file: str, text: str) -> None:
    """Whole or not at all: written aside, then renamed."""
    fs, aside = _fs(spark, file + ".tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, _fs(spark, file)[1]):
        raise OSError(f"{file} exists already")


def _commits(spark: SparkSession, path: str) -> dict[str, list[list[str]]]:
    """Base name to the (date, delta) pairs that it replaces and that may still lie there."""
    names = _children(spark, f"{path}/{COMMITS}")
    done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
    found = {}
    for name in (n for n in names if n.endswith(".json")):
        base = name.removesuffix(".json")
        fs, file = _fs(spark, f"{path}/{COMMITS}/{name}")
        stream = fs.open(file)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found[base] = [] if base in done else json.loads(text)
    return found


def visible(rows: DataFrame, path: str) -> DataFrame:
    """Rows of deltas that no committed base replaces, and of committed bases."""
    commits = _commits(rows.sparkSession, path)
    seen = ~F.col("delta").startswith(BASE) | F.col("delta").isin(*commits) if commits else ~F.col("delta").startswith(BASE)
    for day, deltas in _by_date(pair for pairs in commits.values() for pair in pairs).items():
        seen = seen & ~((F.col("bucket_date") == F.lit(day).cast("date")) & F.col("delta").isin(*deltas))
    return rows.filter(seen)


def _by_date(pairs: Iterable[Sequence[str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for day, delta in pairs:
        out.setdefault(day, []).append(delta)
    return out


def _sweep(spark: SparkSession, path: str) -> None:
    """Remove what commits of earlier runs replaced, and bases that were never committed."""
    commits = _commits(spark, path)
    for base, pairs in commits.items():
        for day, delta in pairs:
            fs, folder = _fs(spark, f"{path}/bucket_date={day}/delta={delta}")
            fs.delete(folder, True)
        if pairs:
            _put(spark, f"{path}/{COMMITS}/{base}.done", "")
    for day in (n for n in _children(spark, path) if n.startswith("bucket_date=")):
        _drop_children(spark, f"{path}/{day}", lambda n: n.startswith(f"delta={BASE}") and n.removeprefix("delta=") not in commits)


def compact(spark: SparkSession, path: str, start: datetime, end: datetime) -> None:
    """Fold the deltas of whole dates into one base.  One compaction runs at a time; writers and readers may go on."""
    _sweep(spark, path)
    low, high = (t.date().isoformat() for t in (start, end))
    days = [n.removeprefix("bucket_date=") for n in _children(spark, path) if n.startswith("bucket_date=")]
    pairs = [
        (day, name.removeprefix("delta="))
        for day in days if low <= day <= high
        for name in _children(spark, f"{path}/bucket_date={day}") if name.startswith("delta=")
    ]
    if not pairs:
        return
    base = BASE + uuid.uuid4().hex
    listed = F.lit(False)
    for day, deltas in _by_date(pairs).items():
        listed = listed | ((F.col("bucket_date") == F.lit(day).cast("date")) & F.col("delta").isin(*deltas))
    rows = spark.read.schema(schemas.FLOW_AGGREGATES + ", delta string").parquet(path).filter(listed)
    write_aggregates(rows, path, base, files_for(rows))
    fs, folder = _fs(spark, f"{path}/{COMMITS}")
    fs.mkdirs(folder)
    _put(spark, f"{path}/{COMMITS}/{base}.json", json.dumps(pairs))


def _drop_children(spark: SparkSession, folder: str, condition) -> int:
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return 0
    dropped = 0
    for status in fs.listStatus(target):
        if status.isDirectory() and condition(status.getPath().getName()):
            fs.delete(status.getPath(), True)
            dropped += 1
    return dropped


def apply_retention(df: DataFrame, now: datetime, days: int, ts: str = "bucket_ts") -> DataFrame:
    """Rows at or after the cutoff; also prunes by date where the table has one."""
    cutoff = now - timedelta(days=check_retention(days))
    kept = df.filter(F.col(ts) >= instant(cutoff))
    if "bucket_date" in df.columns:
        kept = kept.filter(F.col("bucket_date") >= instant(cutoff).cast("date"))
    return kept


def drop_expired(spark: SparkSession, path: str, now: datetime, days: int) -> int:
    """Remove whole expired date folders: a metadata operation, no data is read."""
    cutoff = (now - timedelta(days=check_retention(days))).date().isoformat()
    prefix = "bucket_date="
    return _drop_children(
        spark, path, lambda name: name.startswith(prefix) and name[len(prefix):] < cutoff
    )


def upgrade_aggregates(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """Append rows without collector columns; they become ``unknown``."""
    return (
        current.unionByName(legacy, allowMissingColumns=True)
        .withColumn("collector_kind", normalize_collector_kind(F.coalesce("collector_kind", F.lit(UNKNOWN))))
        .withColumn(
            "collector_id",
            normalize_collector_id(F.col("collector_id"), F.col("collector_kind"), F.lit("")),
        )
    )
