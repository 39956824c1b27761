import random

from helpers import components as plain

from leadcurve.llm.components import components
from leadcurve.llm.work import Work


def check(spark, links):
    work = Work(spark, "test")
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), work, "c").collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = plain(nodes, links)
    assert set(got) == nodes
    groups = {}
    for n in nodes:
        groups.setdefault(got[n], set()).add(want[n])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_chain_star_and_random(spark):
    check(spark, [(i, i + 1) for i in range(60)] + [(5, 5)])
    check(spark, [(500, i) for i in range(200)] + [(-3, 500)])
    rng = random.Random(2)
    check(spark, [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(220)])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Work(spark, "test"), "c").collect() == []
