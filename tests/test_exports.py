"""Exports of ad insights: compressed, several files, each line parsed once; loads that leave little on disk."""

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import functions as F

from leadcurve.functions import actions as act
from leadcurve.functions.numbers import too_large
from leadcurve.operators import insights as ins
from leadcurve.operators import periods
from leadcurve.plans import load, queries
from leadcurve.sources import driver_tables as drv
from leadcurve.sources import tables


def records(spark, n):
    return spark.range(n).selectExpr(
        "'2001-07-30' as date_start", "cast(id as string) as ad_id", "'Quiz/A' as campaign_name", "'1.50' as spend",
        "array(named_struct('action_type', 'purchase', 'value', '2'), named_struct('action_type', 'other', 'value', 'abc')) as actions",
    )


def test_an_export_is_compressed_and_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "RECORDS_PER_FILE", 100)
    out = tmp_path / "export"
    tables.write_insights(records(spark, 1000).coalesce(1), str(out))
    files = [p for p in out.iterdir() if p.name.startswith("part-")]
    assert len(files) == 10 and all(p.name.endswith(".json.gz") for p in files)
    read = tables.read_insights(spark, str(out))
    assert sorted(int(r.ad_id) for r in read.collect()) == list(range(1000))
    assert ins.parse_insights(read).agg(F.sum("vendas"), F.sum("gasto")).first()[:] == (2000, 1500)


def test_an_empty_export(spark, tmp_path):
    tables.write_insights(records(spark, 0), str(tmp_path / "export"))
    assert tables.read_insights(spark, str(tmp_path / "export")).collect() == []


def test_filters_on_fields_do_not_parse_again(spark, tmp_path):
    tables.write_insights(records(spark, 10), str(tmp_path / "export"))
    parsed = ins.parse_insights(tables.read_insights(spark, str(tmp_path / "export")))
    kept = ins.kept_rows(parsed, "Quiz", ["13"], ["3"])
    assert kept.count() == 9
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_the_query_exports_compressed_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "work_folder", lambda spark, name: str(tmp_path / name))
    queries.QUERIES["insights_json"](spark, "/root/testdata/sf0.001")
    files = [p.name for p in Path(tmp_path, "insights").glob("part-*")]
    assert files and all(n.endswith(".json.gz") for n in files)


def test_counts_in_odd_texts(spark):
    from leadcurve.functions.numbers import count_or_zero

    odd = {"abc": 0, "": 0, "NaN": 0, "Infinity": 0, "-": 0, "12": 12, " 7 ": 7, "3.9": 3, "1e3": 1000, "-2.5": -2, "1e30": 0, "x1": 0}
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", F.expr(count_or_zero("t")))
    assert {r[0]: r[1] for r in got.collect()} == odd


def test_facts_of_combined_rows_are_the_daily_facts_in_one_shuffle(spark):
    from leadcurve.sources import driver_tables as drv

    named = drv.loaded_rows(spark, ins.combine_rows(drv.insights(spark, "/root/testdata/sf0.001")).localCheckpoint())
    found = ins.facts_of_combined(named)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert sorted(map(repr, found.collect())) == sorted(map(repr, ins.daily_facts(named).collect()))


def test_shuffles_go_with_their_query(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with tables.shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before


def test_rows_in_ranges_are_not_shuffled_again(spark, tmp_path):
    from leadcurve.sources.snapshots import write_version

    rows = spark.range(1000).selectExpr("date_add(date'2024-01-01', cast(id % 20 as int)) as data", "cast(id as string) as anuncio")
    ranged = rows.repartitionByRange(4, "data", "anuncio").groupBy("data", "anuncio").count()
    days, found = write_version(ranged, str(tmp_path), "t", "v1", ["data", "anuncio"], by_range=True)
    assert len(days) == 20 and found["linhas"] == 1000
    files = list(Path(tmp_path).glob("t/versao=v1/data=*/part-*"))
    assert len(files) <= 20 + 4
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_exports_of_a_load_go_when_it_is_done(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "work_folder", lambda spark, name: str(tmp_path / name))
    written, alive = [], []
    monkeypatch.setattr(queries, "write_insights", lambda records, path: written.append(path) or tables.write_insights(records.limit(50), path))
    monkeypatch.setattr(queries, "_refresh", lambda spark, folder, root, exports, version: alive.append([Path(p).exists() for p in written]) or FakeConfig())
    queries.QUERIES["load_incremental"](spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 4 and len(alive) == 3 and not any(Path(p).exists() for p in written)


class FakeConfig:
    def value(self, key, default):
        return dict.fromkeys(("dias_regravados", "dias_gravados", "linhas_malformadas", "linhas_recusadas"), 0)


# --- what a load reads ------------------------------------------------------
def odd_lines():
    """Records inside and outside of what a load takes, sound, refused and no JSON."""
    plays = [{"action_type": "video_view", "value": "3"}, {"action_type": "video_view", "value": "2.5"}, {"action_type": None, "value": "7"}, {"value": "9"}]
    sales = [{"action_type": "purchase", "value": "1"}, {"action_type": "omni_purchase", "value": "4"}, {"action_type": "landing_page_view", "value": "abc"}, None]
    base = {"date_start": "2024-05-10", "ad_id": "1", "ad_name": "a", "campaign_id": "c", "campaign_name": "Quiz/A", "spend": "1.50", "impressions": "10", "clicks": "2"}
    changes = [
        {}, {"actions": plays}, {"actions": sales, "action_values": [{"action_type": "purchase", "value": "12.345"}, {"action_type": "omni_purchase", "value": "x"}]},
        {"actions": [], "video_3_sec_watched_actions": plays, "video_p25_watched_actions": [{"action_type": "video_view", "value": None}]},
        {"date_start": "2020-01-01"}, {"date_start": "bad"}, {"date_start": None}, {"campaign_name": "Other"}, {"campaign_name": None}, {"spend": None, "clicks": "1e3"},
        {"spend": "1e17"}, {"spend": "NaN"}, {"clicks": "99999999999999999999", "date_start": "2020-01-01"}, {"actions": [{"action_type": "x", "value": "-1E25"}]},
        {"impressions": "0000000000000000000012"}, {"actions": "text"}, {"video_p25_watched_actions": [{"value": "9e18"}], "campaign_name": "Other"},
    ]
    return [json.dumps(base | c) for c in changes] + ['{"date_start": "2024-05-10", "clicks": "1e30", "ad', "[1", "null", "\t", "   ", ""]


def test_a_load_takes_what_was_checked_parsed_and_kept(spark, tmp_path):
    (tmp_path / "export.json").write_text("\n".join(odd_lines()))
    period, path = periods.between("2024-05-01", "2024-05-10"), str(tmp_path / "export.json")
    for campaign in ("Quiz", None):
        taken, seen = load._taken(spark, path, campaign, period)
        sound = ins.check_insights(tables.read_insights(spark, path)).where("motivo is null").drop("motivo")
        expected = ins.kept_rows(ins.parse_insights(sound), campaign, period=period)
        assert taken.dtypes == expected.dtypes
        assert sorted(map(repr, taken.collect())) == sorted(map(repr, expected.collect())) and expected.count() == (7 if campaign else 9)
        assert seen.get["malformadas"] == tables.malformed_insights(spark, path).count() == 4
        assert seen.get["recusadas"] == 4


def test_nested_fields_do_not_pass_the_counting(spark, tmp_path):
    tables.write_insights(records(spark, 10), str(tmp_path / "export"))
    taken, _ = load._taken(spark, str(tmp_path / "export"), "Quiz", periods.between("2001-07-01", "2001-07-31"))
    plan = taken._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_json(") == 1
    while "CollectMetrics" not in plan.nodeName():
        plan = plan.children().head()
    assert "array" not in plan.schema().simpleString()


def test_a_value_is_looked_at_closely_only_if_it_can_be_too_large(spark):
    texts = ["1", "abc", "e", "1e18", "9e18", "1E400", "-9.3e18", "9223372036854775807", "9223372036854775808", "  9999999999999999999 ", "1234567890123456", "12345 678901234567890", "0x1p70", "0x1p70          ", "Infinity", "", None]
    rows = spark.createDataFrame([(t, t, t, [{"action_type": "x", "value": "5"}, {"action_type": "y", "value": t}]) for t in texts], "spend string, impressions string, clicks string, actions array<struct<action_type:string,value:string>>")
    for kept in (["spend"], ["clicks"], ["actions"], rows.columns):
        plain = " ".join(f"when {act.holds_too_large(c) if c == 'actions' else too_large(c, c == 'spend')} then '{c}'" for c in rows.columns if c in kept)
        got = ins.check_insights(rows.select(*kept)).withColumn("esperado", F.expr(f"case {plain} end")).collect()
        assert [r.motivo for r in got] == [r.esperado for r in got] and any(r.motivo for r in got)


def test_records_of_three_loads_are_exported_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(queries, "write_insights", lambda rows, path: written.append(rows.count()) or tables.write_insights(rows, path))
    audits = queries.QUERIES["load_incremental"](spark, "/root/testdata/sf0.001").collect()
    assert len(audits) == 3 and sum(written) == 2 * drv.nested_insights(spark, "/root/testdata/sf0.001").count()


def test_a_task_reads_about_one_file(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    with tables.files_apart(spark):
        assert spark.conf.get(key) == "16m"
    assert spark.conf.get(key, None) == before


def test_digests_of_a_load_sort_once(spark, tmp_path, monkeypatch):
    from leadcurve.sources import local, schemas

    plans = []
    digests = load.day_digests
    monkeypatch.setattr(load, "day_digests", lambda facts: plans.append(facts._jdf.queryExecution().executedPlan().toString()) or digests(facts))
    for name in ("dias", "horas"):
        (tmp_path / f"{name}.json").write_text("\n".join(odd_lines()))
    creatives, aliases = local.local_table(spark, schemas.CREATIVES, []), local.local_table(spark, schemas.ALIASES, [])
    day = dt.date(2024, 5, 10)
    config = load.refresh_ads(spark, str(tmp_path / "t"), str(tmp_path / "dias.json"), str(tmp_path / "horas.json"), creatives, aliases, "v1", day, dt.datetime(2024, 5, 10), load.LoadRules("Quiz"))
    assert config.value(load.AUDIT_KEY, {})["ok"] and plans[0].count("Exchange hashpartitioning(") == 1
    assert plans[0].count("- Sort [") == 1
