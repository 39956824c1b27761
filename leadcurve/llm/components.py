"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leadcurve.llm.work import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """node and root of every node that ``edges`` (a, b) names; root is one node of its component.

    In each round every node points at its smallest neighbour if that is
    smaller than itself, pointers are followed twice, and the edges are drawn
    again between what their ends point at; edges inside one node go. When
    none is left, all nodes of a component point at the same one. A node's
    neighbours meet in a minimum, which combines before the shuffle, so a
    node with very many of them is no harder than others. All state is
    written to shared tables, nothing comes to the driver but whether edges
    are left.
    """
    left = work.keep(edges.where("a <> b").distinct(), f"{name}-edges-0")
    labels = None
    turn = 0
    while True:
        if turn and left.isEmpty():
            return labels.select("node", "root")
        both = left.select("a", "b").union(left.select("b", "a"))
        up = work.keep(both.groupBy("a").agg({"b": "min"}).selectExpr("a as node", "least(a, `min(b)`) as root"), f"{name}-up-{turn}")
        for step in range(2):
            higher = up.selectExpr("node as root", "root as top")
            up = up.join(higher, "root", "left").selectExpr("node", "coalesce(top, root) as root")
            if step == 1:
                up = work.keep(up, f"{name}-jump-{turn}")
        turn += 1
        at_a = up.selectExpr("node as a", "root as ra")
        at_b = up.selectExpr("node as b", "root as rb")
        left = work.keep(left.join(at_a, "a").join(at_b, "b").selectExpr("ra as a", "rb as b").where("a <> b").distinct(), f"{name}-edges-{turn}")
        if labels is None:
            labels = up
        else:
            moved = labels.join(up.selectExpr("node as root", "root as top"), "root", "left").selectExpr("node", "coalesce(top, root) as root")
            labels = work.keep(moved, f"{name}-labels-{turn}")
