"""Readers and writers of stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadcurve.operators.merges import to_layout
from leadcurve.operators.periods import Period, in_date_period
from leadcurve.sources import schemas
from leadcurve.sources.local import local_table


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the shared place that ``spark.checkpoint.dir`` names.

    Only a local session that names none gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="leadcurve-")
    return f"{root.rstrip('/')}/leadcurve/{name}-{uuid.uuid4().hex}"


#: A compressed file is read by one task, so none gets more records than a task can do quickly.
RECORDS_PER_FILE = 250_000


def write_insights(records: DataFrame, path: str) -> None:
    """Nested ad-insight records as JSON lines, compressed: most of a line is field names, which repeat in every line."""
    records.write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).json(path)


def read_insights(spark: SparkSession, path: str | Sequence[str], seen: Observation | None = None) -> DataFrame:
    """Nested ad-insight records from JSON lines.

    The schema is declared: nothing is inferred, numbers are kept as text,
    and a field the export lacks is null. Lines that are no JSON are left
    out; ``malformed_insights`` has them. ``seen`` learns how many lines
    there were (``lidas``) and how many of them were left out
    (``malformadas``), from whatever job reads the records.
    """
    # filters on the fields stay above what is observed: below it, each of them would parse the line again
    lines = _insight_lines(spark, path).observe(
        seen or "linhas", F.expr("count(*) as lidas"), F.expr(f"count_if(record.{MALFORMED} is not null) as malformadas")
    )
    return lines.where(f"record.{MALFORMED} is null").select("record.*").drop(MALFORMED)


def insight_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A record for every line of an ad-insight export; on lines that are no JSON, ``MALFORMED`` has them."""
    return _insight_lines(spark, path).select("record.*")


def malformed_insights(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of an ad-insight export that ``read_insights`` leaves out, as ``linha``."""
    return _insight_lines(spark, path).where(f"record.{MALFORMED} is not null").select("linha")


MALFORMED = "_malformed"


def _insight_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines with something in them, and each as a record that also says if it is no JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    record = F.from_json("value", f"{schemas.INSIGHTS}, {MALFORMED} string", options)
    return spark.read.text(path if isinstance(path, str) else list(path)).where("trim(value) != ''").select(F.col("value").alias("linha"), record.alias("record"))


def read_creative_sheet(sheet: DataFrame) -> DataFrame:
    """A creative sheet of any layout in the current columns, without nameless rows."""
    layout = local_table(sheet.sparkSession, schemas.CREATIVE_SHEET, [])
    return to_layout(sheet, layout).where(F.col("anuncio") != "")


def write_by_month(df: DataFrame, path: str, *order: str, month: str = "mes") -> None:
    """Rewrites a whole table of dated rows.

    Rows are spread by range over ``order`` (the date first), so that every
    file covers few days, no directory holds crumbs, and a day with a large
    part of all rows is cut into several files. Directories by month prune
    at planning time, file statistics do the rest.
    """
    keys = [month, *order]
    (
        df.withColumn(month, F.trunc(order[0], "MM"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(month)
        .parquet(path)
    )


def write_by_day(df: DataFrame, path: str, day: str = "data") -> None:
    """Rewrites a whole table of few days, one directory per day.

    Rows are rebalanced on the day: small days share tasks, a heavy day is
    split over several.
    """
    writer = df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(day).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _configured(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, Spark removes the shuffle files of each query when it has ended.

    Otherwise they stay until the driver happens to collect garbage, so a
    run of many jobs holds the shuffles of all of them on disk at once.
    """
    return _configured(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def files_apart(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, a task reads about one file of an export, also where Spark would give it 128 MB of them.

    Ten of them, millions of records to parse, make so few tasks that most
    cores wait for the last ones.
    """
    return _configured(spark, **{"spark.sql.files.maxPartitionBytes": "16m"})


def replace_days(df: DataFrame, path: str, period: Period, day: str = "data") -> None:
    """Replaces the days of a short, closed period; all other days stay untouched.

    The new rows are staged first, so the table only changes once they are
    complete. Then only the period's own directories are written. A day that
    has stored rows but no new ones ends up empty. Running it again gives
    the same table.
    """
    if not (period.start and period.end):
        raise ValueError("the period needs both bounds")
    spark = df.sparkSession
    staging = work_folder(spark, "staged")
    try:
        write_by_day(df.where(in_date_period(period, day)), staging, day)
        _take_over(spark.read.schema(df.schema).parquet(staging), path, period, day)
    finally:
        drop_folder(spark, staging)


def _take_over(staged: DataFrame, path: str, period: Period, day: str) -> None:
    spark, inside = staged.sparkSession, in_date_period(period, day)
    (
        staged.hint("rebalance", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )
    stored = spark.read.schema(staged.schema).parquet(path).where(inside).select(day).distinct()
    # at most one row per day of the period
    for row in stored.join(staged.select(day).distinct(), day, "left_anti").collect():
        drop_folder(spark, f"{path}/{day}={row[0]}")
