"""Tables switched in one step: readers, killed writes, keys, the incremental load, compaction, session state."""

import datetime as dt
import json
import pathlib
from decimal import Decimal

import pytest
from conftest import SF

from leadcurve.operators import events as ev
from leadcurve.operators import funnel as fn
from leadcurve.operators import insights as ins
from leadcurve.operators import periods
from leadcurve.plans.load import AUDIT_KEY, DAILY, HOURLY, LoadRules, refresh_ads
from leadcurve.sources import dimensions, schemas, snapshots
from leadcurve.sources import driver_tables as drv
from leadcurve.streaming import pings as st

D = dt.date
HOURS = "data date, hora int, anuncio string, vendas bigint"
KEY = ("data", "hora", "anuncio")
WINDOW = periods.between("2024-01-04", "2024-01-10")


def hours(spark, *rows):
    return spark.createDataFrame([(D(2024, 1, d), h, a, v) for d, h, a, v in rows], HOURS)


def read(spark, root, period=periods.EVERYTHING, config=None):
    days = (config or snapshots.read_config(spark, root)).days("horas")
    return sorted((r.data.day, r.hora, r.anuncio, r.vendas) for r in snapshots.read_days(spark, root, "horas", HOURS, days, period).collect())


@pytest.fixture
def root(spark, tmp_path):
    """A table with the days 1 to 7 in two versions."""
    place = str(tmp_path / "tables")
    snapshots.replace_period(hours(spark, *[(d, 1, "a", d) for d in range(1, 8)]), place, "horas", "v1", periods.between("2024-01-01", "2024-01-07"), KEY)
    snapshots.replace_period(hours(spark, (7, 2, "b", 70)), place, "horas", "v2", periods.between("2024-01-07", "2024-01-07"), KEY)
    return place


def test_readers_see_old_or_new_days(spark, root):
    before = snapshots.read_config(spark, root)
    old = read(spark, root)
    assert old == [(d, 1, "a", d) for d in range(1, 7)] + [(7, 2, "b", 70)]
    # everything but the switch: what a killed write leaves
    snapshots.write_version(hours(spark, (6, 2, "b", 60), (9, 2, "b", 90)), root, "horas", "v3", KEY)
    assert read(spark, root) == old
    snapshots.replace_period(hours(spark, (6, 2, "b", 60), (9, 2, "b", 90), (20, 1, "x", 1)), root, "horas", "v3", WINDOW, KEY)
    assert read(spark, root) == [(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "a", 3), (6, 2, "b", 60), (9, 2, "b", 90)]
    assert read(spark, root, config=before) == old
    assert read(spark, root, periods.between("2024-01-06", "2024-01-08")) == [(6, 2, "b", 60)]
    snapshots.replace_period(hours(spark), root, "horas", "v4", WINDOW, KEY)
    assert read(spark, root) == [(1, 1, "a", 1), (2, 1, "a", 2), (3, 1, "a", 3)]
    with pytest.raises(ValueError):
        snapshots.replace_period(hours(spark), root, "horas", "v5", periods.EVERYTHING, KEY)


def test_only_named_folders_of_the_period_are_read(spark, root):
    days = snapshots.read_config(spark, root).days("horas")
    found = snapshots.read_days(spark, root, "horas", HOURS, days, periods.between("2024-01-06", "2024-01-07"))
    assert sorted({p.split("/horas/")[1].rsplit("/", 1)[0] for p in found.inputFiles()}) == ["versao=v1/data=2024-01-06", "versao=v2/data=2024-01-07"]


def test_repeated_keys_refuse_a_version(spark, root):
    old = read(spark, root)
    with pytest.raises(snapshots.RefusedWrite) as refused:
        snapshots.replace_period(hours(spark, (6, 2, "b", 60), (6, 2, "b", 61), (6, 3, None, 1), (6, 3, None, 1), (6, 4, "c", 1)), root, "horas", "v3", WINDOW, KEY)
    assert sorted((r.hora, r.anuncio, r.linhas) for r in refused.value.report.collect()) == [(2, "b", 2), (3, None, 2)]
    assert read(spark, root) == old and "versao=v3" not in snapshots.folder_names(spark, f"{root}/horas")


def test_key_check_adds_no_shuffle(spark):
    """Facts grouped by their key lie together already when they are counted by it."""
    facts = ins.hourly_facts(drv.insights(spark, SF))
    counted = facts.selectExpr("*", f"count(*) over (partition by {', '.join(KEY)}) as n")
    exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (facts, counted)]
    assert exchanges[0] == exchanges[1]


def test_two_writers_cannot_both_switch(spark, root):
    config = snapshots.read_config(spark, root)
    snapshots.switch(spark, root, config, {"a": 1})
    with pytest.raises(snapshots.Conflict):
        snapshots.switch(spark, root, config, {"a": 2})
    after = snapshots.read_config(spark, root)
    assert after.value("a", None) == 1 and after.days("horas") == config.days("horas")
    assert snapshots.read_config(spark, root, back=1).values == config.values
    assert not [n for n in snapshots.folder_names(spark, f"{root}/config") if n.startswith("rascunho")]


def test_sweep_keeps_what_readers_may_use(spark, root):
    old = read(spark, root)
    snapshots.replace_period(hours(spark, *[(d, 5, "n", d) for d in range(1, 8)]), root, "horas", "v3", periods.between("2024-01-01", "2024-01-07"), KEY)
    before = snapshots.read_config(spark, root, back=1)
    assert snapshots.sweep(spark, root, ["horas"]) == []
    assert read(spark, root, config=before) == old
    snapshots.switch(spark, root, snapshots.read_config(spark, root), {"a": 1})
    assert sorted(p.rsplit("=")[-1] for p in snapshots.sweep(spark, root, ["horas"])) == ["v1", "v2"]
    assert len(read(spark, root)) == 7


def test_merge_rows(spark, root):
    snapshots.merge_rows(hours(spark, (6, 1, "a", 66), (6, 9, "z", 1), (12, 1, "a", 12)), root, "horas", "v3", KEY, HOURS)
    assert read(spark, root) == [(d, 1, "a", d) for d in range(1, 6)] + [(6, 1, "a", 66), (6, 9, "z", 1), (7, 2, "b", 70), (12, 1, "a", 12)]
    assert {v["versao"] for d, v in snapshots.read_config(spark, root).days("horas").items() if d in ("2024-01-06", "2024-01-12")} == {"v3"}
    version = snapshots.read_config(spark, root).version
    assert snapshots.merge_rows(hours(spark), root, "horas", "v4", KEY, HOURS).version == version


def test_empty_root(spark, tmp_path):
    assert read(spark, str(tmp_path)) == [] and snapshots.read_config(spark, str(tmp_path)).values == {}


# --- incremental load -------------------------------------------------------
def record(day, ad, spend="2.50", hour=None, sales="1", **more):
    return {
        "date_start": day, "ad_id": ad, "ad_name": f"ad{ad}", "campaign_id": "c", "campaign_name": "Quiz/A", "spend": spend, "impressions": "10", "clicks": "1",
        "actions": [{"action_type": "purchase", "value": sales}], "hourly_stats_aggregated_by_advertiser_time_zone": hour,
    } | more


@pytest.fixture
def load(spark, table, tmp_path):
    """A load of these records and lines; returns the config and its audit."""
    creatives, place = table(schemas.CREATIVES), str(tmp_path / "tables")

    def run(version, daily, hourly=(), lines=()):
        paths = []
        for name, records in (("dias", daily), ("horas", hourly)):
            path = tmp_path / f"{name}-{version}.json"
            path.write_text("\n".join([*map(json.dumps, records), *lines]))
            paths.append(str(path))
        config = refresh_ads(spark, place, *paths, creatives, dimensions.aliases(spark, []), version, D(2024, 5, 10), dt.datetime(2024, 5, 10, 9), LoadRules("Quiz"))
        return config, config.value(AUDIT_KEY, {})

    run.root = place
    return run


DAYS = [record("2024-05-10", "1"), record("2024-05-10", "2"), record("2024-05-09", "1"), record("2024-05-01", "3")]
HOURLY_RECORDS = [record("2024-05-10", "1", hour="13:00:00 - 13:59:59")]


def facts(spark, load, config):
    schema = "anuncio string, gasto decimal(18,2), data date"
    return sorted((r.data.day, r.anuncio, r.gasto) for r in snapshots.read_days(spark, load.root, DAILY, schema, config.days(DAILY)).collect())


def test_only_changed_days_are_written(spark, load):
    first, audit = load("v1", DAYS, HOURLY_RECORDS)
    assert audit["ok"] and [audit[k] for k in ("linhas_meta", "dias_gravados", "dias_regravados", "criativos", "horas_gravadas")] == [4, 4, 3, 3, 1]
    second, audit = load("v2", DAYS[::-1], HOURLY_RECORDS)
    assert [audit[k] for k in ("linhas_meta", "dias_gravados", "dias_regravados", "criativos", "horas_gravadas")] == [4, 4, 0, 3, 1]
    assert "versao=v2" not in snapshots.folder_names(spark, f"{load.root}/{DAILY}")
    assert facts(spark, load, second) == facts(spark, load, first)
    # one amount changed, one day gone
    third, audit = load("v3", [DAYS[0], DAYS[1], record("2024-05-09", "1", "9.00")], HOURLY_RECORDS)
    assert [audit[k] for k in ("dias_gravados", "dias_regravados")] == [3, 1]
    assert {d: v["versao"] for d, v in third.days(DAILY).items()} == {"2024-05-10": "v1", "2024-05-09": "v3"}
    assert facts(spark, load, third) == [(9, "ad1", Decimal("9.00")), (10, "ad1", Decimal("2.50")), (10, "ad2", Decimal("2.50"))]
    assert [p.name for p in pathlib.Path(f"{load.root}/{DAILY}/versao=v3").glob("data=*")] == ["data=2024-05-09"]
    assert len(facts(spark, load, first)) == 4  # a reader of the first load


def test_failed_load_switches_nothing(spark, load):
    config, _ = load("v1", DAYS, HOURLY_RECORDS)
    failed, audit = load("v1", DAYS[:1], HOURLY_RECORDS)
    assert audit["ok"] is False and "in use" in audit["erro"]
    assert {k: v for k, v in failed.values.items() if k != AUDIT_KEY} == {k: v for k, v in config.values.items() if k != AUDIT_KEY}
    assert len(facts(spark, load, failed)) == 4


def test_bad_lines_and_numbers_are_counted(spark, load):
    huge = [record("2024-05-10", "8", spend="1e17"), record("2024-05-10", "8", sales="99999999999999999999"), record("2024-05-10", "9", clicks="1e30")]
    fine = [record("2024-05-10", "6", spend="1e3", clicks="x", sales="9223372036854775807"), record("2024-05-10", "7", spend="inf", sales="NaN")]
    config, audit = load("v1", DAYS + huge + fine, HOURLY_RECORDS, ['{"date_start": "2024', "[1", "  "])
    assert audit["ok"] and [audit[k] for k in ("linhas_malformadas", "linhas_recusadas", "linhas_meta")] == [4, 3, 6]
    assert {a: g for d, a, g in facts(spark, load, config) if a in ("ad6", "ad7", "ad8", "ad9")} == {"ad6": Decimal("1000.00"), "ad7": Decimal("0.00")}


def test_load_reads_no_table_it_wrote(spark, load, monkeypatch):
    """After the daily facts, creatives and hours are written, nothing reads them for the audit."""
    read_paths = []
    reader = type(spark.read)
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, f=reader.parquet, **o: read_paths.extend(paths) or f(self, *paths, **o))
    load("v1", DAYS, HOURLY_RECORDS)
    assert read_paths and not [p for p in read_paths if p.startswith(load.root)]


def test_no_rows_at_all(spark, load):
    config, audit = load("v1", [])
    assert audit["ok"] and [audit[k] for k in ("linhas_meta", "dias_gravados", "dias_regravados", "criativos", "horas_gravadas")] == [0] * 5
    assert config.days(DAILY) == config.days(HOURLY) == {}


# --- actions, numbers, bounds --------------------------------------------------
def test_one_fold_an_array(spark):
    plan = ins.parse_insights(drv.nested_insights(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    # the actions and four arrays of plays
    assert plan.count("aggregate(") == 5 and "array_max(transform(filter(array(struct(action_type, purchase, value, cast(vendas" not in plan


def test_records_that_do_not_fit(spark):
    many = [{"action_type": "purchase", "value": "1"}, {"action_type": "x", "value": "-1e25"}]
    rows = [record("2024-05-10", "1"), record("2024-05-10", "2", actions=many), record("2024-05-10", "3", impressions="9223372036854775808"), record("2024-05-10", "4", actions=None, spend=None), record("2024-05-10", "5", action_values=[{"action_type": "purchase", "value": "12345678901234567.5"}])]
    checked = ins.check_insights(spark.createDataFrame(rows, schemas.INSIGHTS))
    assert {r.ad_id: r.motivo for r in checked.collect()} == {"1": None, "2": "actions", "3": "impressions", "4": None, "5": "action_values"}


def test_period_reaches_the_scan(spark, tmp_path):
    period = periods.between("2024-01-05", "2024-01-06")
    sheet = drv.event_sheet(spark, SF)
    sheet.write.parquet(str(tmp_path / "sheet"))
    stored = spark.read.parquet(str(tmp_path / "sheet"))
    found = ev.events_of_period(stored, period)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03)" in plan.replace(" ", "") and "PushedFilters: [Or(" in plan
    expected = periods.within_local_period(ev.accepted(ev.clean_events(stored)), period)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) and found.count() > 0


def test_bounds_let_every_row_of_the_period_through(spark):
    texts = ["2024-01-05 02:59:59", "2024-01-05 03:00:00", "2024-01-07 02:59:59", "2024-01-04T21:00:00-08:00", "2024-01-07T05:00:00+09:00", "2024/01/05 10:00:00", "2024/1/6 10:00:00", "Jan 5, 2024", "1/6/2024 10:00", "01/05/2024 10:00", "5 Jan 2024 10:00", "05-Jan-2024 10:00:00", "12/31/2023", "2/5/2024", "5 Jan 2024", "05 Jan 2024", "4-Jan-2024 23:00 -0300", "Fri Jan 05 2024 10:00:00", "  2024-01-05 10:00:00", "2024-01-05", "2023/12/31 10:00:00", "2024-02-01 00:00:00", "bad", None]
    texts += [f"{day} Jan 2024" for day in range(1, 32)] + [f"{month}/20/2024" for month in range(1, 13)]
    rows = spark.createDataFrame([(i, t, "sess-1", "etapa", "3", "v1", "v2") for i, t in enumerate(texts)], schemas.EVENT_SHEET)
    for start, end in (("2024-01-18", "2024-02-20"), ("2024-01-05", "2024-01-06"), (None, "2024-01-06"), ("2024-01-05", None), (None, None)):
        period = periods.between(start, end)
        expected = periods.within_local_period(ev.accepted(ev.clean_events(rows)), period)
        assert {r.id for r in ev.events_of_period(rows, period).collect()} == {r.id for r in expected.collect()}


# --- funnels and variants out of days ----------------------------------------
def test_presets_of_days(spark, tmp_path):
    events = drv.events(spark, SF)
    # sessions over several days
    joined = events.selectExpr("* except (sessao)", "concat('sess-', id % 40) as sessao")
    days = st.session_days(joined)
    days.write.partitionBy("dia").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    chosen = periods.presets(drv.EVENT_DAY)
    found = fn.funnel_by_period_of_days(stored, chosen)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, fn.funnel_by_period(fn.stage_pings(joined), chosen).collect()))
    closed = {n: p for n, p in chosen.items() if p.start}
    plan = fn.funnel_by_period_of_days(stored, closed)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "PartitionFilters: [isnotnull(dia" in plan


def test_sketches_merge_for_any_period(spark):
    events = spark.range(60_000).selectExpr("id", "timestamp_ntz'2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(id % 10 as int)) as ts", "concat('s', id % 20000) as sessao", "'etapa' as tipo", "3 as etapa", "concat('v', id % 2) as variante", "cast(null as string) as pagina", "cast(null as string) as dados")
    days = fn.variant_days(events)
    for period in (periods.EVERYTHING, periods.between("2024-01-03", "2024-01-04")):
        exact = {r.variante: r for r in fn.variants_available(events, period=period).collect()}
        for r in fn.variants_of_days(days, period=period).collect():
            assert abs(r.sessoes - exact[r.variante].sessoes) <= 0.03 * exact[r.variante].sessoes
            assert (r.ini, r.fim) == (exact[r.variante].ini, exact[r.variante].fim)


# --- compaction and session state --------------------------------------------
@pytest.fixture
def arriving(spark, tmp_path):
    raw = drv.table(spark, SF, "events")
    folder = str(tmp_path / "arriving")
    raw.repartition(5).write.parquet(folder)
    return folder, raw


def test_compaction_knows_replayed_batches(spark, arriving, tmp_path):
    folder, raw = arriving
    target, root = str(tmp_path / "events"), str(tmp_path / "tables")

    def ingest(checkpoint, origin="pings"):
        st.ingest(drv.as_pings(st.file_stream(spark, folder, raw.schema, files_per_batch=1)), target, str(tmp_path / checkpoint), origin).awaitTermination()

    def stored():
        return sorted(r.id for r in st.read_events(spark, target, root).select("id").collect())

    ingest("one")
    whole = sorted(r.id for r in spark.read.parquet(target).select("id").collect())
    assert stored() == whole
    files = len(st.read_events(spark, target, root).inputFiles())
    st.compact_events(spark, target, root)
    assert stored() == whole and len(st.read_events(spark, target, root).inputFiles()) < files
    assert snapshots.read_config(spark, root).value(st.LEDGER, None) == {"geracoes": ["g1"], "lotes": {"pings": [[0, 4]]}}
    ingest("one once more")  # batches 0 to 4 are written again
    assert stored() == whole
    assert len(st.retire_compacted(spark, target, root)) == 5 and stored() == whole
    ingest("one and again")
    assert stored() == whole
    ingest("two", "other")
    assert len(stored()) == 2 * len(whole)
    st.compact_events(spark, target, root, most=1)  # generations are merged too
    assert len(stored()) == 2 * len(whole)
    ledger = snapshots.read_config(spark, root).value(st.LEDGER, None)
    assert len(ledger["geracoes"]) == 1 and ledger["lotes"] == {"other": [[0, 4]], "pings": [[0, 4]]}
    before = snapshots.read_config(spark, root).version
    assert st.compact_events(spark, target, root).version == before
    st.retire_compacted(spark, target, root)
    assert len(stored()) == 2 * len(whole) and snapshots.folder_names(spark, f"{root}/{st.GENERATIONS}") == [f"geracao={ledger['geracoes'][0]}"]


def test_ledger_ranges():
    ledger = {"geracoes": [], "lotes": {"a": [[0, 3], [7, 7]]}}
    assert st._with_batches(ledger, [("a", 4), ("a", 6), ("b", 2)]) == {"a": [[0, 4], [6, 7]], "b": [[2, 2]]}


def test_state_store_equals_batch(spark, arriving, tmp_path):
    folder, raw = arriving
    root, checkpoint = str(tmp_path / "tables"), str(tmp_path / "position")

    def run():
        events = drv.as_events(st.file_stream(spark, folder, raw.schema, files_per_batch=2))
        st.keep_sessions(events, root, checkpoint).awaitTermination()

    run()
    late = raw.where("event_id < 300").selectExpr("* except (event_id, props)", "event_id + 1000000 as event_id", "'{\"k\": 33}' as props").select(raw.columns)
    late.write.mode("append").parquet(folder)
    run()
    everything = drv.as_events(raw.unionByName(late))
    pages = dimensions.pages(spark)
    for options in ({}, {"period": periods.between("2024-01-05", "2024-01-09")}, {"variants": ["v1"], "pages": pages, "funnel": "brasil", "source": "tiktok"}):
        kept = st.kept_sessions(spark, root, options.get("period", periods.EVERYTHING))
        assert fn.funnel_totals(st.tracked_sessions(kept, **options)).collect() == fn.funnel(everything, **options).collect()
    version = snapshots.read_config(spark, root).version
    run()
    assert snapshots.read_config(spark, root).version == version
    assert spark.conf.get(st._STORE) != st._ROCKS
