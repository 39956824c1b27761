"""Tables laid out by key: what a refresh moves, who sees what, refused keys."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from conftest import SF

from leadcurve.operators import creatives as cr
from leadcurve.operators import insights as ins
from leadcurve.operators import merges
from leadcurve.sources import driver_tables as drv
from leadcurve.sources import keyed, snapshots

COSTS = "id string, nome string, valor decimal(12,2)"
CHANGES = f"{COSTS}, op string"


def costs(spark, *rows, schema=COSTS):
    return spark.createDataFrame([(i, n, None if v is None else Decimal(v), *more) for i, n, v, *more in rows], schema)


def read(spark, root, config=None):
    return sorted((r.id or "", r.nome, None if r.valor is None else int(r.valor)) for r in keyed.read_keyed(spark, root, "custos", config).collect())


def change(changes):
    return lambda table: merges.apply_changes(table, changes, "id")


@pytest.fixture
def root(spark, tmp_path):
    place = str(tmp_path / "tables")
    keyed.write_keyed(costs(spark, *[(str(i), "a", i) for i in range(50)]), place, "custos", "v1", ["id"])
    return place


def above(plan, marker):
    """The operators above the one line with a marker, nearest first."""
    lines = plan.splitlines()
    depth = [re.search(r"[A-Za-z*(]", line).start() if re.search(r"[A-Za-z*(]", line) else 0 for line in lines]
    at = [i for i, line in enumerate(lines) if marker in line]
    assert len(at) == 1, plan
    found, least = [], depth[at[0]]
    for i in range(at[0] - 1, -1, -1):
        if depth[i] < least:
            found.append(lines[i][depth[i]:])
            least = depth[i]
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changes_alone_are_shuffled(spark, root):
    changes = costs(spark, ("3", "b", 7, "update"), schema=CHANGES)
    plan = plan_of(merges.apply_changes(keyed.read_keyed(spark, root, "custos"), changes, "id"))
    over = above(plan, "Bucketed: true")
    assert any("Join" in line for line in over) and not any("Exchange" in line for line in over), plan
    assert plan.count("Exchange hashpartitioning") == 1, plan  # the changes, by key


def test_creatives_alone_stay_where_they_are(spark, tmp_path):
    root = str(tmp_path)
    keyed.write_keyed(drv.creatives(spark, SF), root, "criativos", "v1", ["anuncio"])
    rollup = ins.ad_rollup(ins.with_canonical_name(drv.insights(spark, SF), drv.aliases(spark)), drv.AD_DAY)
    plan = plan_of(cr.upsert_creatives(keyed.read_keyed(spark, root, "criativos"), rollup, dt.datetime(2001, 7, 31)))
    assert not any("Exchange" in line for line in above(plan, "Bucketed: true")), plan


def test_refresh_keeps_the_layout(spark, root, tmp_path):
    changes = costs(spark, ("3", "b", 7, "update"), ("4", None, None, "delete"), ("90", "n", 1, "insert"), schema=CHANGES)
    expected = sorted([(str(i), "a", i) for i in range(50) if i not in (3, 4)] + [("3", "b", 7), ("90", "n", 1)])
    for version in ("v2", "v3"):  # the second time all three are refused or without effect
        keyed.refresh_keyed(spark, root, "custos", version, change(changes))
        assert read(spark, root) == expected
        files = [f.name for f in (tmp_path / "tables" / "custos" / f"versao={version}").glob("*.parquet")]
        assert len(files) <= 8 and len({re.search(r"_(\d{5})\.", f).group(1) for f in files}) == len(files)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("leadcurve_")]


def test_readers_and_killed_writes(spark, root):
    before = snapshots.read_config(spark, root)
    old = read(spark, root)
    update = change(costs(spark, ("3", "b", 7, "update"), schema=CHANGES))
    # everything but the switch: what a killed write leaves
    keyed._written(update(keyed.read_keyed(spark, root, "custos")), root, "custos", "v2", ["id"], 8)
    assert read(spark, root) == old
    with pytest.raises(ValueError):
        keyed.refresh_keyed(spark, root, "custos", "v2", update)
    keyed.refresh_keyed(spark, root, "custos", "v3", update)
    assert read(spark, root) != old and read(spark, root, before) == old
    assert [f.rsplit("=")[-1] for f in keyed.sweep_keyed(spark, root, "custos")] == ["v2"]
    assert read(spark, root, before) == old
    with pytest.raises(ValueError):
        keyed.read_keyed(spark, root, "outra")


def test_repeated_keys_are_refused(spark, root):
    old = read(spark, root)
    more = costs(spark, ("3", "z", 1), ("x", "z", 1), (None, "z", 1), (None, "y", 2))
    with pytest.raises(snapshots.RefusedWrite) as refused:
        keyed.refresh_keyed(spark, root, "custos", "v2", lambda table: table.unionByName(more))
    assert sorted((r.id or "", r.linhas) for r in refused.value.report.collect()) == [("", 2), ("3", 2)]
    assert read(spark, root) == old
    with pytest.raises(snapshots.RefusedWrite):
        keyed.write_keyed(more, root, "outra", "v1", ["id"])
    assert snapshots.folder_names(spark, f"{root}/outra/versao=v1") == []


def test_other_writer(spark, root):
    def slow(table):
        keyed.refresh_keyed(spark, root, "custos", "v2", change(costs(spark, ("1", "b", 1, "update"), schema=CHANGES)))
        return table

    with pytest.raises(snapshots.Conflict):
        keyed.refresh_keyed(spark, root, "custos", "v3", slow)
    assert ("1", "b", 1) in read(spark, root)


def test_more_partitions_than_buckets(spark, root):
    """A session that shuffles into more parts deals the table anew once; later refreshes leave it there."""
    update = change(costs(spark, ("3", "b", 7, "update"), schema=CHANGES))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        config = keyed.refresh_keyed(spark, root, "custos", "v2", update)
        assert config.value("chaves:custos", None)["baldes"] == 12
        plan = plan_of(update(keyed.read_keyed(spark, root, "custos")))
        assert not any("Exchange" in line for line in above(plan, "Bucketed: true")), plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(read(spark, root)) == 50


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    keyed.write_keyed(costs(spark), root, "custos", "v1", ["id"])
    assert read(spark, root) == []
    keyed.refresh_keyed(spark, root, "custos", "v2", change(costs(spark, schema=CHANGES)))
    assert read(spark, root) == []
    keyed.refresh_keyed(spark, root, "custos", "v3", change(costs(spark, ("1", "a", 5, "insert"), schema=CHANGES)))
    assert read(spark, root) == [("1", "a", 5)]
