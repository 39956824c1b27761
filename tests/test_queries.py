"""Every registered query against its SQL on the driver's tables."""

import pytest
from compare import duck, duck_rows, spark_rows
from conftest import SF, SF_CHECKED

import __spark_entry__ as contract
from leadcurve.plans.oracle import ORACLE_SQL
from leadcurve.plans.queries import QUERIES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE_SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 34
    assert rows[0].ret == 100.0 and rows[0].queda == 0.0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con, sql = duck(SF), contract.oracle_sql()[name]
    df = contract.queries()[name](spark, SF)
    assert spark_rows(df) == duck_rows(con, sql)
    types = {d[0]: str(d[1]) for d in con.execute(sql).description}
    assert {c: KINDS[t] for c, t in df.dtypes} == types


def test_known_funnel(spark):
    """Values worked out beforehand for the checked scale."""
    run = contract.queries()
    total = run["funnel_summary"](spark, SF_CHECKED).first()
    assert (total.visitantes, total.compraram, total.fim) == (3677, 147, 157)
    steps = [r.sessoes for r in run["funnel_steps"](spark, SF_CHECKED).collect()]
    assert steps == [
        3677, 3626, 3584, 3529, 3476, 3420, 3361, 3311, 3254, 3185, 3118, 2799, 2799, 2799, 2799, 2702, 2603,
        2504, 2393, 2292, 2180, 1653, 1653, 1653, 1653, 1494, 1315, 1122, 947, 765, 557, 419, 292, 157,
    ]
    alerts = {r.n: r.queda for r in run["funnel_alerts"](spark, SF_CHECKED).collect()}
    assert alerts == {12: 8.7, 22: 14.3, 28: 5.3}
    drop = run["funnel_biggest_drop"](spark, SF_CHECKED).first()
    assert (drop.tela, drop.queda, drop.alertas) == (22, 14.3, "12,22,28")


def test_known_rejects(spark):
    counts = {r.motivo: r.linhas for r in contract.queries()["event_rejects"](spark, SF_CHECKED).collect()}
    assert counts == {"ok": 8710, "sessao": 400, "tipo": 200, "etapa": 490, "ts": 200}
