"""Streams of pings: ingest, session state, resumable backfill.

Every job drains what is there and stops (``availableNow``). Its checkpoint
is the position: a later run goes on from it, and a new checkpoint folder
starts over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadcurve.operators.events import accepted, clean_events, ping_to_row, rejected
from leadcurve.operators.funnel import of_page_group, of_variants, session_rollup, stage_pings
from leadcurve.operators.periods import EVERYTHING, Period, local_date, require_utc, within_dates
from leadcurve.sources import schemas
from leadcurve.sources.snapshots import Config, folder_names, merge_rows, read_config, read_days, switch
from leadcurve.sources.tables import drop_folder


def file_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream, new files being picked up as they arrive.

    ``files_per_batch`` bounds what a failure repeats, not what is read.
    """
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def _rewrite(rows: DataFrame):
    """A writer that replaces all of its folder, whatever the session's overwrite mode is."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "static")


def _add_batches(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    origin: str,
    step: Callable[[DataFrame], DataFrame],
    refused: tuple[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> StreamingQuery:
    """Writes ``step`` of every micro-batch to a directory of that batch, by local day.

    A replayed batch overwrites its own directory, so each row lands once.
    Nothing stored before is touched. Streams of other origins may write
    under the same target. ``refused`` names a folder for the rows that the
    batch does not keep, and how to get them; it is laid out alike.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        place = f"origem={origin}/lote={batch_id}"
        _rewrite(step(batch).hint("rebalance", "dia")).partitionBy("dia").parquet(f"{target}/{place}")
        if refused:
            folder, rows = refused
            _rewrite(rows(batch)).parquet(f"{folder}/{place}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _by_day(events: DataFrame) -> DataFrame:
    return require_utc(events).withColumn("dia", F.expr(local_date("ts")))


def _add_checked(stream, target, checkpoint, origin, rejects, checked) -> StreamingQuery:
    refused = (rejects, lambda batch: rejected(checked(batch))) if rejects else None
    return _add_batches(stream, target, checkpoint, origin, lambda batch: _by_day(accepted(checked(batch))), refused)


def ingest(
    pings: DataFrame, target: str, checkpoint: str, origin: str = "pings", rejects: str | None = None
) -> StreamingQuery:
    """Adds ping requests to the event table; rows that break its limits are refused.

    A variant or page that is too long is refused, not cut. With ``rejects``
    the refused rows go to that folder with their ``motivo``.
    """

    def checked(batch: DataFrame) -> DataFrame:
        return clean_events(ping_to_row(batch), table_checks=True, cut_variant=False)

    return _add_checked(pings, target, checkpoint, origin, rejects, checked)


def backfill(
    sheet_rows: DataFrame,
    target: str,
    checkpoint: str,
    origin: str = "historico",
    rejects: str | None = None,
    zone: str = "UTC",
) -> StreamingQuery:
    """Adds cleaned history rows to the event table, each exactly once over all runs.

    With ``rejects`` the rows that are skipped go to that folder with their
    ``motivo``. ``zone`` is that of time text without an offset. To start
    over, take a new checkpoint and a new origin (or empty the old one).
    """

    def checked(batch: DataFrame) -> DataFrame:
        return clean_events(batch, table_checks=True, zone=zone)

    return _add_checked(sheet_rows, target, checkpoint, origin, rejects, checked)


def batch_report(stored: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per origin: rows kept and skipped, batches, and rows read in all.

    Both tables are read with their directories ``origem`` and ``lote``.
    """
    one = "origem", "lote"
    rows = stored.select(*one, F.lit(1).alias("mantidas"), F.lit(0).alias("puladas")).unionAll(
        rejects.select(*one, F.lit(0), F.lit(1))
    )
    per_batch = rows.groupBy(*one).agg(F.sum("mantidas").alias("mantidas"), F.sum("puladas").alias("puladas"))
    return per_batch.groupBy("origem").agg(
        F.sum("mantidas").alias("mantidas"),
        F.sum("puladas").alias("puladas"),
        F.count("*").alias("lotes"),
        F.expr("sum(mantidas + puladas) as total"),
    )


def compact_session_days(partials: DataFrame, path: str) -> None:
    """Writes many partial results as one table by local day, which takes their place.

    ``path`` is a new folder. Later partial results are added beside it and
    read together with it; a batch that was compacted and is replayed changes
    nothing, as maximum and boolean-or do not care about repeats.
    """
    _rewrite(merge_session_days(partials).hint("rebalance", "dia")).partitionBy("dia").parquet(path)


# --- compaction of events ---------------------------------------------------
LEDGER, GENERATIONS = "eventos:compactados", "eventos_compactos"
#: A compaction that finds so many generations merges them into one.
MOST_GENERATIONS = 8
_STORED = f"{schemas.EVENTS}, dia date, origem string, lote int"


def _batches(spark: SparkSession, target: str) -> list[tuple[str, int]]:
    """The batches that lie complete under the event table."""
    found = []
    for origin in folder_names(spark, target):
        if origin.startswith("origem="):
            for batch in folder_names(spark, f"{target}/{origin}"):
                if batch.startswith("lote=") and "_SUCCESS" in folder_names(spark, f"{target}/{origin}/{batch}"):
                    found.append((origin[7:], int(batch[5:])))
    return found


def _covered(ledger: dict, origin: str, batch: int) -> bool:
    return any(low <= batch <= high for low, high in ledger["lotes"].get(origin, ()))


def _with_batches(ledger: dict, batches: list[tuple[str, int]]) -> dict[str, list[list[int]]]:
    """The ledger's batches by origin, as ranges, and these ones."""
    out = {}
    for origin in {o for o, _ in batches} | set(ledger["lotes"]):
        numbers = sorted([[b, b] for o, b in batches if o == origin] + ledger["lotes"].get(origin, []))
        ranges: list[list[int]] = []
        for low, high in numbers:
            if ranges and low <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], high)
            else:
                ranges.append([low, high])
        out[origin] = ranges
    return out


def _stored(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], _STORED)
    rows = spark.read.schema(_STORED).option("basePath", base).parquet(*paths)
    return rows.selectExpr(*[field.split()[0] for field in _STORED.split(", ")])


def compact_events(spark: SparkSession, target: str, root: str, most: int = MOST_GENERATIONS) -> Config:
    """Gathers the small files of all complete batches into a generation of large ones, by local day.

    The ledger in the config of ``root`` has the generations and, by origin,
    the ranges of batches they cover; it is switched in one step. From then
    on ``read_events`` passes those batches over, whether their folders are
    still there, were removed, or are written once more by a replay.
    """
    config = read_config(spark, root)
    ledger = config.value(LEDGER, {"geracoes": [], "lotes": {}})
    waiting = [(o, b) for o, b in _batches(spark, target) if not _covered(ledger, o, b)]
    if not waiting:
        return config
    rows, kept = _stored(spark, target, [f"{target}/origem={o}/lote={b}" for o, b in waiting]), ledger["geracoes"]
    if len(kept) >= most:
        rows = rows.unionByName(_stored(spark, f"{root}/{GENERATIONS}", [f"{root}/{GENERATIONS}/geracao={g}" for g in kept]))
        kept = []
    generation = f"g{config.version + 1}"
    # origin and batch go along, so that every row can be traced
    _rewrite(rows.hint("rebalance", "dia")).partitionBy("dia").parquet(f"{root}/{GENERATIONS}/geracao={generation}")
    return switch(spark, root, config, {LEDGER: {"geracoes": [*kept, generation], "lotes": _with_batches(ledger, waiting)}})


def read_events(spark: SparkSession, target: str, root: str) -> DataFrame:
    """All events, each once: the generations, and the batches that none of them covers."""
    ledger = read_config(spark, root).value(LEDGER, {"geracoes": [], "lotes": {}})
    waiting = [f"{target}/origem={o}/lote={b}" for o, b in _batches(spark, target) if not _covered(ledger, o, b)]
    generations = [f"{root}/{GENERATIONS}/geracao={g}" for g in ledger["geracoes"]]
    return _stored(spark, f"{root}/{GENERATIONS}", generations).unionByName(_stored(spark, target, waiting))


def retire_compacted(spark: SparkSession, target: str, root: str) -> list[str]:
    """Removes batches that a generation covers and generations that were merged; readers of the former state lose their files."""
    ledger = read_config(spark, root).value(LEDGER, {"geracoes": [], "lotes": {}})
    gone = [f"{target}/origem={o}/lote={b}" for o, b in _batches(spark, target) if _covered(ledger, o, b)]
    gone += [f"{root}/{GENERATIONS}/{g}" for g in folder_names(spark, f"{root}/{GENERATIONS}") if g.startswith("geracao=") and g[8:] not in ledger["geracoes"]]
    for path in gone:
        drop_folder(spark, path)
    return gone


# --- session state ----------------------------------------------------------
def session_days(events: DataFrame) -> DataFrame:
    """Furthest screen and buy click per session, local day, variant and page.

    Fine enough for every funnel filter, and mergeable: maximum and
    boolean-or do not care about order, repeats or late pings.
    """
    return session_rollup(_by_day(stage_pings(events)), "dia", "variante", "pagina")


def merge_session_days(partials: DataFrame) -> DataFrame:
    """Many partial results as one; written to a new table it takes their place."""
    return partials.groupBy("dia", "variante", "pagina", "sessao").agg(
        F.max("maxi").alias("maxi"), F.bool_or("comprou").alias("comprou")
    )


def track_sessions(
    events: DataFrame, target: str, checkpoint: str, origin: str = "pings"
) -> StreamingQuery:
    """Keeps session-days up to date, one partial result per micro-batch.

    No state is held and nothing stored is rewritten, so a batch costs what
    its pings cost, however long the history.
    """
    return _add_batches(events, target, checkpoint, origin, session_days)


def tracked_sessions(
    partials: DataFrame,
    pages: DataFrame | None = None,
    period: Period = EVERYTHING,
    variants=None,
    funnel: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Sessions out of the partial results, with the filters of the batch funnel."""
    kept = of_variants(within_dates(partials, period, "dia"), variants)
    return of_page_group(kept, pages, funnel, source).groupBy("sessao").agg(
        F.max("maxi").alias("maxi"), F.bool_or("comprou").alias("comprou")
    )


# --- session state in a state store -----------------------------------------
SESSIONS = "sessoes_dia"
SESSION_KEY = ("data", "variante", "pagina", "sessao")
SESSION_DAYS = "data date, variante string, pagina string, sessao string, maxi int, comprou boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SESSION_KEY).agg(F.max("maxi").alias("maxi"), F.bool_or("comprou").alias("comprou"))


def keep_sessions(events: DataFrame, root: str, checkpoint: str, origin: str = "pings") -> StreamingQuery:
    """Keeps session-days in a RocksDB state store and merges what changed into the table ``sessoes_dia`` of ``root``.

    A keyed aggregate in update mode: each micro-batch gives the session-days
    that its pings changed, late ones included, and only the days they touch
    are written anew, in one switch. Maximum and boolean-or do not care
    about repeats, so a replayed batch and other streams into the same table
    are merged alike. State grows with the sessions, on local disks and under
    the checkpoint; ``track_sessions`` holds none.
    """
    days = session_days(events).withColumnRenamed("dia", "data")

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # one version a run of a batch: a replay never writes where readers are
            tries = read_config(batch.sparkSession, root).version
            merge_rows(batch, root, SESSIONS, f"{origin}-{batch_id}-{tries}", SESSION_KEY, SESSION_DAYS, _merged)
        finally:
            batch.unpersist()

    spark = events.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return (
            days.writeStream.outputMode("update")
            .foreachBatch(merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_STORE, before)


def kept_sessions(spark: SparkSession, root: str, period: Period = EVERYTHING) -> DataFrame:
    """The session-days of ``keep_sessions``, as ``tracked_sessions`` takes them; only folders of the period are read."""
    days = read_config(spark, root).days(SESSIONS)
    return read_days(spark, root, SESSIONS, SESSION_DAYS, days, period).withColumnRenamed("data", "dia")
