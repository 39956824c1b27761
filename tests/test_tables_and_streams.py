"""Writers, merges, the load job and the streams."""

import datetime as dt
import json
import pathlib
from decimal import Decimal

import pytest
from conftest import SF

from leadcurve.api import Dashboard
from leadcurve.operators import funnel as fn
from leadcurve.operators import insights as ins
from leadcurve.operators import merges, periods
from leadcurve.plans.load import AUDIT_KEY, LoadRules, load_ads
from leadcurve.sources import dimensions
from leadcurve.sources import driver_tables as drv
from leadcurve.sources.tables import (
    read_creative_sheet,
    replace_days,
    work_folder,
    write_by_day,
    write_by_month,
)
from leadcurve.streaming import pings as st

D = dt.date
HOURS = "data date, hora int, anuncio string, vendas bigint"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_merges(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    more = spark.createDataFrame([(2, "B"), (4, "D")], "id int, x string")
    ids = lambda df: {r.id: r.x for r in df.collect()}
    added = merges.insert_missing(table, more.union(more), "id")
    assert added.count() == 4 and ids(added) == {1: "a", 2: "b", 3: "c", 4: "D"}
    assert ids(merges.upsert(table, more, "id")) == {1: "a", 2: "B", 3: "c", 4: "D"}
    changes = spark.createDataFrame(
        [(1, None, "delete"), (2, "B", "update"), (9, "n", "insert")], "id int, x string, op string"
    )
    assert ids(merges.apply_changes(table, changes, "id")) == {2: "B", 3: "c", 9: "n"}
    assert merges.change_rejects(table, changes, "id").collect() == []


def test_insert_missing_takes_the_smallest(spark):
    table = spark.createDataFrame([(1, "a")], "id int, x string")
    more = spark.createDataFrame([(4, "E"), (4, "D"), (4, None)], "id int, x string")
    assert {(r.id, r.x) for r in merges.insert_missing(table, more, "id").collect()} == {(1, "a"), (4, None)}


def test_changes_without_effect(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    changes = spark.createDataFrame(
        [(1, "A", "insert"), (2, "B", "update"), (2, "BB", "update"), (7, "G", "update"), (8, None, "delete"),
         (9, "n", "insert"), (9, "n", "insert"), (3, "c", "rename")],
        "id int, x string, op string",
    )
    got = merges.apply_changes(table, changes, "id")
    assert sorted((r.id, r.x) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    refused = {(r.id, r.mudancas, r.motivo) for r in merges.change_rejects(table, changes, "id").collect()}
    assert refused == {(1, 1, "existente"), (2, 2, "repetida"), (7, 1, "ausente"), (8, 1, "ausente"), (9, 2, "repetida"), (3, 1, "operacao")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FullOuter") == 1 and "LeftAnti" not in plan


def test_writers_replace_whole_tables_in_any_mode(spark, tmp_path):
    path = str(tmp_path / "daily")
    month = "data date, anuncio string"
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_by_month(spark.createDataFrame([(D(2024, 1, 1), "a"), (D(2024, 2, 1), "b")], month), path, "data", "anuncio")
        write_by_month(spark.createDataFrame([(D(2024, 2, 2), "c")], month), path, "data", "anuncio")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [r.anuncio for r in spark.read.parquet(path).collect()] == ["c"]


def test_replace_days_leaves_no_staging(spark, tmp_path):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "leadcurve"
    before = {p.name for p in root.glob("staged-*")}
    new = spark.createDataFrame([(D(2024, 1, 5), 1, "a", 5)], HOURS)
    replace_days(new, str(tmp_path / "hours"), periods.between("2024-01-04", "2024-01-10"))
    assert {p.name for p in root.glob("staged-*")} <= before


def test_replace_days(spark, tmp_path):
    path = str(tmp_path / "hours")
    first = [(D(2024, 1, d), 1, "a", d) for d in range(1, 8)]
    write_by_day(spark.createDataFrame(first, HOURS), path)
    window = periods.between("2024-01-04", "2024-01-10")
    new = spark.createDataFrame([(D(2024, 1, 6), 2, "b", 60), (D(2024, 1, 9), 2, "b", 90)], HOURS)
    expected = [(1, 1), (2, 2), (3, 3), (6, 60), (9, 90)]   # days 4, 5 and 7 are cleared
    for _ in range(2):
        replace_days(new, path, window)
        got = spark.read.parquet(path).collect()
        assert sorted((r.data.day, r.vendas) for r in got) == expected


def test_replace_days_without_new_rows(spark, tmp_path):
    path = str(tmp_path / "hours")
    write_by_day(spark.createDataFrame([(D(2024, 1, 5), 1, "a", 5)], HOURS), path)
    nothing = spark.createDataFrame([], HOURS)
    replace_days(nothing, path, periods.between("2024-01-04", "2024-01-10"))
    assert spark.read.schema(HOURS).parquet(path).count() == 0
    with pytest.raises(ValueError):
        replace_days(nothing, path, periods.EVERYTHING)


def test_replace_days_of_a_new_table(spark, tmp_path):
    path = str(tmp_path / "hours")
    replace_days(
        spark.createDataFrame([(D(2024, 1, 5), 1, "a", 5)], HOURS), path, periods.between("2024-01-04", "2024-01-10")
    )
    assert [r.vendas for r in spark.read.parquet(path).collect()] == [5]


def test_write_by_month_prunes(spark, tmp_path):
    path = str(tmp_path / "daily")
    facts = drv.ad_daily(spark, SF)
    for _ in range(2):
        write_by_month(facts, path, "data", "anuncio")
    stored = spark.read.parquet(path)
    assert rows(stored.drop("mes").select(*facts.columns)) == rows(facts)
    month = periods.within_dates(stored, periods.between("2001-03-05", "2001-03-20"))
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    assert rows(month.select("data", "anuncio")) == rows(
        periods.within_dates(facts, periods.between("2001-03-05", "2001-03-20")).select("data", "anuncio")
    )


def test_sheet_layouts(spark):
    old = spark.createDataFrame([("1", "a"), ("2", ""), ("3", None)], "ad_id string, anuncio string")
    got = read_creative_sheet(old)
    assert got.count() == 1 and len(got.columns) == 31
    assert read_creative_sheet(got).collect() == got.collect()


def test_work_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = work_folder(spark, "x"), work_folder(spark, "x")
    assert one.startswith(root) and one != two


# --- load job ---------------------------------------------------------------
def record(day, ad, name, hour=None, sales="1", campaign="Quiz/A", campaign_id="c"):
    return {
        "date_start": day, "ad_id": ad, "ad_name": name, "campaign_id": campaign_id, "campaign_name": campaign,
        "spend": "2.50", "impressions": "10", "clicks": "1",
        "actions": [{"action_type": "purchase", "value": sales}],
        "hourly_stats_aggregated_by_advertiser_time_zone": hour,
    }


def test_load_job(spark, table, tmp_path):
    from leadcurve.sources import schemas
    from leadcurve.sources.tables import read_insights

    def export(name, records):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(json.dumps(r) for r in records))
        return read_insights(spark, str(path))

    daily = export("daily", [
        record("2024-05-10", "1", "main"),
        record("2024-05-10", "2", "alias"),
        record("2024-05-01", "3", "past"),
        record("2020-01-01", "3", "past"),                       # before the window
        record("2024-05-10", "9", "excluded"),
        record("2024-05-10", "8", "x", campaign_id="gone"),
        record("2024-05-10", "7", "y", campaign="Other"),
    ])
    hourly = export("hourly", [
        record("2024-05-10", "1", "main", "13:00:00 - 13:59:59"),
        record("2024-05-10", "9", "excluded", "13:00:00 - 13:59:59"),   # exclusions do not apply to hours
        record("2024-05-01", "1", "main", "13:00:00 - 13:59:59"),       # before the window
    ])
    creatives = table(schemas.CREATIVES, ("main", "0", "c", "testado", "video", *[None] * 8, 0, Decimal("0.00"), None))
    config, root = dimensions.config(spark), str(tmp_path / "tables")
    when = dt.datetime(2024, 5, 10, 9)
    for version in ("v1", "v2"):                                        # the second run changes nothing
        config = load_ads(
            daily, hourly, creatives, dimensions.aliases(spark, [("alias", "main")]), config, root, version,
            D(2024, 5, 10), when, LoadRules("Quiz", ["gone"], ["9"]),
        )
        facts = spark.read.parquet(f"{root}/criativos_diario/{version}").collect()
        assert sorted((r.data.day, r.anuncio, r.vendas, r.gasto) for r in facts) == [
            (1, "past", 1, Decimal("2.50")), (10, "main", 2, Decimal("5.00")),
        ]
        hours = spark.read.parquet(f"{root}/criativos_hora").collect()
        assert sorted((r.hora, r.anuncio) for r in hours) == [(13, "excluded"), (13, "main")]
        stored = {r.anuncio: r for r in spark.read.parquet(f"{root}/criativos/{version}").collect()}
        assert (stored["main"].status, stored["main"].formato) == ("ativo", "video")
        assert stored["past"].status == "testado"
        entries = {r.chave: r.valor for r in config.collect()}
        assert set(entries) == {"medalhas", AUDIT_KEY}
        audit = json.loads(entries[AUDIT_KEY])
        assert audit["ok"] is True
        assert [audit[k] for k in ("linhas_meta", "dias_gravados", "criativos", "horas_gravadas")] == [5, 2, 2, 2]


def test_failed_load_is_noted(spark, table, tmp_path):
    from leadcurve.sources import schemas

    broken = spark.createDataFrame([("x",)], "date_start string")
    creatives = table(schemas.CREATIVES)
    config = load_ads(
        broken, broken, creatives, dimensions.aliases(spark, []), dimensions.config(spark), str(tmp_path), "v1",
        D(2024, 5, 10), dt.datetime(2024, 5, 10, 9),
    )
    audit = json.loads({r.chave: r.valor for r in config.collect()}[AUDIT_KEY])
    assert audit["ok"] is False and audit["erro"]


def test_load_of_hours_as_they_are_exported(spark, table, tmp_path):
    """Hourly records have no campaign and no ids; a run without any hour is fine too."""
    from leadcurve.sources import schemas
    from leadcurve.sources.tables import malformed_insights, read_insights

    path = tmp_path / "hours.json"
    lines = [
        json.dumps({"date_start": "2024-05-10", "ad_name": name, "spend": "1.50", "actions": [{"action_type": "purchase", "value": "2"}],
                    "hourly_stats_aggregated_by_advertiser_time_zone": "07:00:00 - 07:59:59"})
        for name in ("main", "other")
    ]
    path.write_text("\n".join([lines[0], '{"date_start": "2024-05-10", "ad_na', lines[1]]))
    assert [r.linha for r in malformed_insights(spark, str(path)).collect()] == ['{"date_start": "2024-05-10", "ad_na']
    hourly, root = read_insights(spark, str(path)), str(tmp_path / "tables")
    assert hourly.count() == 2
    daily = spark.createDataFrame([record("2024-05-10", "1", "main")], schemas.INSIGHTS)
    creatives = table(schemas.CREATIVES)
    work = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "leadcurve"
    before = set(work.glob("registros-*"))

    def run(hours, version):
        config = load_ads(
            daily, hours, creatives, dimensions.aliases(spark, []), dimensions.config(spark), root, version,
            D(2024, 5, 10), dt.datetime(2024, 5, 10, 9), LoadRules("Quiz"),
        )
        return json.loads({r.chave: r.valor for r in config.collect()}[AUDIT_KEY])

    assert run(hourly, "v1")["horas_gravadas"] == 2
    assert sorted(r.anuncio for r in spark.read.parquet(f"{root}/criativos_hora").collect()) == ["main", "other"]
    audit = run(hourly.where("false"), "v2")
    assert audit["ok"] is True and audit["horas_gravadas"] == 0 and audit["dias_gravados"] == 1
    assert set(work.glob("registros-*")) == before

    broken = load_ads(
        spark.createDataFrame([("x",)], "date_start string"), hourly, creatives, dimensions.aliases(spark, []),
        dimensions.config(spark), root, "v3", D(2024, 5, 10), dt.datetime(2024, 5, 10, 9),
    )
    assert json.loads({r.chave: r.valor for r in broken.collect()}[AUDIT_KEY])["ok"] is False
    assert spark.read.parquet(f"{root}/criativos_diario/v2").count() == 1       # what was there stays


# --- streams ----------------------------------------------------------------
@pytest.fixture
def split_events(spark, tmp_path):
    """The driver's events in several files, as they would arrive."""
    raw = drv.table(spark, SF, "events")
    folder = str(tmp_path / "arriving")
    raw.repartition(5).write.parquet(folder)
    return folder, raw


def test_session_stream_equals_batch(spark, split_events, tmp_path):
    folder, raw = split_events
    target, checkpoint = str(tmp_path / "sessions"), str(tmp_path / "position")
    for _ in range(2):
        stream = st.file_stream(spark, folder, raw.schema, files_per_batch=2)
        st.track_sessions(drv.as_events(stream), target, checkpoint).awaitTermination()
    partials = spark.read.parquet(target)
    events, pages = drv.as_events(raw), dimensions.pages(spark)
    assert partials.select("lote").distinct().count() == 3
    for options in (
        {},
        {"period": periods.between("2024-01-05", "2024-01-09")},
        {"variants": ["v1"], "pages": pages, "funnel": "brasil", "source": "tiktok"},
    ):
        expected = fn.funnel(events, **options).collect()
        for stored in (partials, st.merge_session_days(partials)):
            assert fn.funnel_totals(st.tracked_sessions(stored, **options)).collect() == expected


def test_late_and_repeated_pings(spark, split_events, tmp_path):
    folder, raw = split_events
    target, checkpoint = str(tmp_path / "sessions"), str(tmp_path / "position")
    run = lambda: st.track_sessions(
        drv.as_events(st.file_stream(spark, folder, raw.schema)), target, checkpoint
    ).awaitTermination()
    run()
    raw.where("event_id < 300").write.mode("append").parquet(folder)      # old pings once more
    run()
    batch = fn.session_rollup(fn.stage_pings(drv.as_events(raw)))
    streamed = st.tracked_sessions(spark.read.parquet(target))
    assert rows(streamed) == rows(batch)


def test_two_streams_share_the_event_table(spark, split_events, tmp_path):
    folder, raw = split_events
    target = str(tmp_path / "events")
    stream = lambda: st.file_stream(spark, folder, raw.schema)
    st.backfill(drv.as_event_sheet(stream()), target, str(tmp_path / "one")).awaitTermination()
    old = spark.read.parquet(target).count()
    st.ingest(drv.as_pings(stream()), target, str(tmp_path / "two")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.where("origem = 'historico'").count() == old
    assert stored.where("origem = 'pings'").count() > 0
    # the stored table is pruned by local day
    day = periods.within_local_period(stored, periods.between("2024-01-05", "2024-01-05"))
    assert "PartitionFilters: [isnotnull(dia" in day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == stored.where("dia = date'2024-01-05'").count()


def test_backfill_goes_on_and_starts_over(spark, tmp_path):
    raw = drv.table(spark, SF, "events")
    source, target = str(tmp_path / "history"), str(tmp_path / "events")
    sheet = drv.as_event_sheet(raw)
    sheet.where("id < 500").write.parquet(source)

    def run(checkpoint, into=target):
        stream = st.file_stream(spark, source, sheet.schema)
        st.backfill(stream, into, str(tmp_path / checkpoint)).awaitTermination()
        return spark.read.parquet(into).count()

    part = run("position")
    assert run("position") == part
    sheet.where("id >= 500").write.mode("append").parquet(source)
    whole = run("position")
    assert whole > part and run("position") == whole
    assert run("another position", str(tmp_path / "fresh")) == whole


def test_ingest_refuses_long_variants_and_keeps_pages(spark, tmp_path):
    from leadcurve.sources import schemas

    source, target, rejects = (str(tmp_path / n) for n in ("pings", "events", "refused"))
    at = dt.datetime(2024, 1, 5, 10)
    sent = [
        (1, at, None, "sess-1", "3", "x" * 23, None, "tiktok"), (2, at, None, "sess-2", "3", "x" * 24, None, "tiktok"),
        (3, at, None, "sess-3", "3", "1", None, "p" * 25), (4, at, "respostas", "sess-4", "99999999999", "", '{"a":1,"a":2}', None),
        (5, at, "respostas", "sess-5", "7", "", '{"a":1,"a":2}', None),
    ]
    spark.createDataFrame(sent, schemas.PING).write.parquet(source)
    for _ in range(2):
        stream = st.file_stream(spark, source, spark.read.parquet(source).schema)
        st.ingest(stream, target, str(tmp_path / "position"), rejects=rejects).awaitTermination()
    kept = {r.id: r for r in spark.read.parquet(target).collect()}
    assert set(kept) == {1, 5} and kept[1].pagina == "tiktok" and kept[5].dados == '{"a":1,"a":2}'
    assert {r.id: r.motivo for r in spark.read.parquet(rejects).collect()} == {2: "variante", 3: "pagina", 4: "etapa"}
    report = st.batch_report(spark.read.parquet(target), spark.read.parquet(rejects)).first()
    assert tuple(report) == ("pings", 2, 3, 1, 5)


# --- functions of the dashboard ---------------------------------------------
def test_dashboard_functions(spark):
    board = Dashboard(
        drv.events(spark, SF), dimensions.pages(spark), drv.creatives(spark, SF), drv.aliases(spark),
        drv.ad_daily(spark, SF), ins.hourly_facts(drv.insights(spark, SF)),
    )
    row = board.fn_funil("2024-01-05", "2024-01-20", ["v0"], "brasil", "meta").first()
    assert [s.n for s in row.etapas] == list(range(1, 35)) and row.etapas[0].sessoes == row.visitantes
    assert board.fn_funil().first().visitantes > row.visitantes
    sessions = [r.sessoes for r in board.fn_variantes().collect()]
    assert sessions == sorted(sessions, reverse=True) and len(sessions) == 3
    assert len(board.fn_criativos("2001-01-01").columns) == 22
    days = [r.data for r in board.fn_diario("2001-01-01", "2001-02-01").collect()]
    assert days == sorted(days) and min(days) >= D(2001, 1, 1)
    assert [r.hora for r in board.fn_horario().collect()] == list(range(24))
