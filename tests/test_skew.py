"""One session, ad or day holding a third of all rows: same results, combined before the shuffle."""

from pyspark.sql import functions as F

from leadcurve.operators import funnel as fn
from leadcurve.operators import insights as ins
from leadcurve.plans.queries import QUERIES
from leadcurve.sources import driver_tables as drv

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_session(spark):
    events = drv.events(spark, SF)
    hot = events.withColumn("sessao", F.expr("if(id % 3 = 0, 'sess-hot', sessao)"))
    sessions = fn.session_rollup(fn.stage_pings(hot))
    brute = {}
    for r in hot.where("tipo = 'etapa'").collect():
        top, bought = brute.get(r.sessao, (0, False))
        brute[r.sessao] = (max(top, r.etapa if r.etapa <= 34 else 0), bought or r.etapa == 35)
    assert {r.sessao: (r.maxi, r.comprou) for r in sessions.collect()} == brute
    assert "partial_max" in plan(sessions)


def test_hot_variant(spark):
    hot = drv.events(spark, SF).withColumn("variante", F.expr("if(id % 3 = 0, 'v9', variante)"))
    seen = {r.variante: r.sessoes for r in fn.variants_available(hot).collect()}
    brute = {}
    for r in hot.where("tipo = 'etapa' and variante is not null").collect():
        brute.setdefault(r.variante, set()).add(r.sessao)
    assert seen == {v: len(s) for v, s in brute.items()}
    # the first shuffle spreads the sessions of a variant
    text = plan(fn.variants_available(hot))
    first = text[text.rindex("Exchange hashpartitioning(") :].split("\n")[0]
    assert "variante" in first and "sessao" in first


def test_hot_ad_and_day(spark):
    rows = drv.insights(spark, SF).withColumns(
        {"ad_name": F.expr("if(clicks % 3 = 0, 'hot', ad_name)"), "data": F.expr("if(clicks % 3 = 1, date'2001-07-31', data)")}
    )
    facts = ins.daily_facts(ins.with_canonical_name(rows, drv.aliases(spark)))
    assert "partial_sum" in plan(facts)
    assert facts.groupBy("data", "anuncio").count().where("count > 1").count() == 0
    assert facts.agg(F.sum("clicks")).first() == rows.agg(F.sum("clicks")).first()


def test_without_broadcast_joins(spark):
    """The other way of joining gives the same rows."""
    names = ["ad_daily", "creative_report", "funnel_page_filter", "ad_rollup_status"]
    rows = lambda: {n: sorted(map(repr, QUERIES[n](spark, SF).collect())) for n in names}
    expected = rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan(QUERIES["ad_daily"](spark, SF))
        assert rows() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
