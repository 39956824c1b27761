"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one kept per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.components import components
from leadcurve.llm.work import Work, ship, tidy

THRESHOLD = 0.9
#: Centroids are fitted on so many vectors at most, those with the lowest hashes.
SAMPLE = 20_000
PER_CELL = 400
MAX_CELLS = 2048
ROUNDS = 8
#: Rows of a block that streams past; a group of cells has up to GROUP blocks of vectors.
BLOCK = 1500
GROUP = 4


def unit_rows(vectors: pa.ListArray, size: int) -> np.ndarray:
    """Vectors as rows of length 1, in double precision, shorter ones with zeros behind."""
    lengths = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy()
    # scaled first, so that squares neither overflow nor vanish
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids on the unit sphere."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(cells, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        length = np.linalg.norm(sums, axis=1)
        filled = length > 1e-9
        centres[filled] = sums[filled] / length[filled, None]
    return centres


def cells_of(rows: np.ndarray, centres: np.ndarray, threshold: float, reach: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and which cells can own a partner of it.

    A partner at the threshold is cos * x + sin * u with u across x. It
    crosses the plane between the own cell h and another cell c only if
    cos * x.(h - c) <= sin * u.(c - h). At most u.(c - h) is the length of
    the part of c - h across x, which makes the test x.(h - c) <= sin * |c - h|;
    no partner fails it. A ``reach`` cuts u.(c - h) to ``reach`` * |c - h| / sqrt(d - 1).
    """
    near = rows @ centres.T
    own = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[own]
    margin = near[np.arange(len(rows)), own][:, None] - near
    sine = np.sqrt(1 - threshold**2)
    can = margin <= sine * apart + 1e-9
    if reach is not None:
        can &= threshold * margin <= sine * min(1.0, reach / np.sqrt(max(rows.shape[1] - 1, 1))) * apart + 1e-9
    return own, can


def group_cells(centres: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """A group number for every cell: cells are halved along their main direction until a group has ``limit`` vectors or one cell."""
    group = np.zeros(len(centres), np.int32)
    waiting, number = [np.arange(len(centres))], 0
    while waiting:
        cells = waiting.pop()
        if len(cells) == 1 or counts[cells].sum() <= limit:
            group[cells] = number
            number += 1
            continue
        shifted = centres[cells] - centres[cells].mean(0)
        order = cells[np.argsort(shifted @ np.linalg.svd(shifted, full_matrices=False)[2][0], kind="stable")]
        middle = int(np.searchsorted(np.cumsum(counts[order]), counts[order].sum() / 2))
        middle = min(max(middle, 1), len(order) - 1)
        waiting += [order[:middle], order[middle:]]
    return group


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the component of every row and column of a block of links that has one."""
    i, j = np.nonzero(links)
    by_column = np.argsort(j, kind="stable")
    rows, row_at = np.unique(i, return_index=True)
    columns, column_at = np.unique(j[by_column], return_index=True)
    low, high = left.copy(), right.copy()
    while True:
        new_low, new_high = low.copy(), high.copy()
        new_low[rows] = np.minimum(low[rows], np.minimum.reduceat(high[j], row_at))
        new_high[columns] = np.minimum(high[columns], np.minimum.reduceat(new_low[i[by_column]], column_at))
        if (new_low == low).all() and (new_high == high).all():
            nodes = np.concatenate((left[rows], right[columns]))
            roots = np.concatenate((low[rows], high[columns]))
            return nodes[nodes != roots], roots[nodes != roots]
        low, high = new_low, new_high


def _own_cells(centres: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = unit_rows(batch.column("vector").slice(at, BLOCK), size)
                yield pa.RecordBatch.from_arrays([pa.array((rows @ centres.value.T).argmax(1).astype(np.int32))], ["own"])

    return run


def _assign(centres: np.ndarray, group: np.ndarray, size: int, threshold: float, reach: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = group.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own, near = cells_of(unit_rows(part.column("vector"), size), centres.value, threshold, reach)
                # of two groups the vectors of the higher one pass the lower one's
                groups = [np.unique(of[row][of[row] <= of[h]]) for row, h in zip(near, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of[own]), pa.array(groups, pa.list_(pa.int32()))], ["vid", "copies", "vector", "own", "groups"])

    return run


def _compare(size: int, threshold: float):
    """Rows vid, n_links, to be added up, of both ends of every link; rows a, b that connect what links.

    Rows come sorted by group, part and role, the block's own vectors first;
    those of the group and of higher ones stream past them. A link between
    two groups is met once and counts for both ends; one inside a group is
    met from both ends and counts for the block's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, seen = None, None, None

        def counted(vid, n_links):
            return pa.RecordBatch.from_arrays([pa.array(vid), pa.array(n_links), pa.nulls(len(vid), pa.int64()), pa.nulls(len(vid), pa.int64())], ["vid", "n_links", "a", "b"])

        for batch in batches:
            cell, part, passing = (batch.column(c).to_numpy() for c in ("cell", "part", "passing"))
            changes = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(passing) != 0)) + 1
            for a, b in zip(np.concatenate(([0], changes)), np.concatenate((changes, [len(cell)])), strict=True):
                for at in range(a, b, BLOCK):
                    rows = batch.slice(at, min(BLOCK, b - at))
                    vid, copies, home = (rows.column(c).to_numpy() for c in ("vid", "copies", "home"))
                    unit = unit_rows(rows.column("vector"), size)
                    if not passing[a]:
                        if key != (cell[a], part[a]):
                            if own is not None:
                                yield counted(own[0], seen)
                            key, own, seen = (cell[a], part[a]), (vid, unit, copies), copies - 1
                        else:
                            own, seen = tuple(np.concatenate(x) for x in zip(own, (vid, unit, copies), strict=True)), np.concatenate((seen, copies - 1))
                    elif key == (cell[a], part[a]):
                        links = own[1] @ unit.T >= threshold
                        links &= own[0][:, None] != vid[None, :]
                        if links.any():
                            seen = seen + links @ copies
                            far = np.flatnonzero(links.any(0) & (home != cell[a]))
                            if len(far):
                                yield counted(vid[far], own[2] @ links[:, far])
                            nodes, roots = _forest(links, own[0], vid)
                            yield pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.array(nodes), pa.array(roots)], ["vid", "n_links", "a", "b"])
        if own is not None:
            yield counted(own[0], seen)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, reach: float | None = None, per_cell: int = PER_CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one vector with a number of copies. Centroids come from
    spherical k-means on a bounded sample. Every vector belongs to the cell
    of its nearest centroid; cells that lie together form groups, and a
    group's vectors are one block (a large cell's are cut into several).
    Every vector also passes the blocks of all groups up to its own that have
    a cell in which a partner can lie, and cosines are products of blocks in
    double precision. No link is missed, whatever the vectors' directions,
    and each counts for both its ends. On vectors without structure that is
    half of all pairs. A ``reach`` below sqrt(d - 1) passes by cells that
    only partners in rare directions are in, and may miss links.

    A null vector, one with a null, NaN or infinite component, an empty one
    and a zero one link with nothing: n_links 0, component_id the own vec_id,
    kept. A shorter vector counts as one with zeros behind. Rows with a null
    vec_id are kept only if they link with nothing. Rows that repeat a vec_id
    count as vectors of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    work = Work(spark, "near-duplicates")
    ok = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<double>) as embedding").selectExpr("vec_id", "embedding", f"coalesce({ok}, false) as ok")
    rows = rows.selectExpr("vec_id", "ok", "case when ok then transform(embedding, x -> x + 0D) end as vector")
    rows = work.keep(rows.selectExpr("*", "xxhash64(vector) as k1", "xxhash64('second', vector) as k2"), "rows")
    distinct = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # the key of a vector stands for it where its id is null or repeats
    distinct = work.keep(distinct.selectExpr("k1 as vid", "k2", "vec_id", "copies", "vector"), "distinct")
    n, size = distinct.selectExpr("count(*)", "coalesce(max(size(vector)), 1)").first()
    cells = int(min(MAX_CELLS, max(1, -(-n // per_cell))))
    share = min(1.0, 1.1 * SAMPLE / max(n, 1))
    drawn = distinct.where(F.expr(f"pmod(vid, 1000003) < {share * 1000003}")).orderBy("vid").limit(SAMPLE).select("vector").collect()
    centres = spherical_kmeans(unit_rows(pa.array([r.vector for r in drawn], pa.list_(pa.float64())), size), cells) if drawn else np.zeros((1, size))
    shared = spark.sparkContext.broadcast(centres)
    limit = GROUP * BLOCK
    counts = np.zeros(len(centres), np.int64)
    for r in distinct.select("vector").mapInArrow(tidy(_own_cells(shared, size)), "own int").groupBy("own").count().collect():
        counts[r.own] = r["count"]
    groups = spark.sparkContext.broadcast(group_cells(centres, counts, limit))
    assigned = work.keep(distinct.select("vid", "copies", "vector").mapInArrow(tidy(_assign(shared, groups, size, threshold, reach)), "vid bigint, copies bigint, vector array<double>, own int, groups array<int>"), "assigned")
    parts = work.keep(assigned.groupBy("own").count().selectExpr("own as cell", f"cast(ceil(count / {limit}D) as int) as parts"), "parts")
    owned = assigned.join(parts, F.expr("own = cell")).selectExpr("cell", "cast(pmod(xxhash64(vid), parts) as int) as part", "0 as passing", "vid", "copies", "own as home", "vector")
    passing = assigned.selectExpr("explode(groups) as cell", "vid", "copies", "own as home", "vector").join(parts, "cell").selectExpr("cell", "explode(sequence(0, parts - 1)) as part", "1 as passing", "vid", "copies", "home", "vector")
    dealt = owned.unionByName(passing).repartition("cell", "part").sortWithinPartitions("cell", "part", "passing")
    found = work.keep(dealt.mapInArrow(tidy(_compare(size, threshold)), "vid bigint, n_links bigint, a bigint, b bigint"), "found")
    counts = found.where("vid is not null").groupBy("vid").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.where("a is not null").select("a", "b"), work, "links")
    grouped = distinct.select("vid", "k2", "vec_id").join(roots, F.expr("vid = node"), "left").selectExpr("vid", "k2", "vec_id", "coalesce(root, vid) as root")
    grouped = work.keep(grouped.join(counts, "vid", "left").selectExpr("vid", "k2", "vec_id", "root", "coalesce(n_links, 0) as n_links"), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    per_vector = work.keep(grouped.join(smallest, "root").selectExpr("vid as k1", "k2", "n_links", "component_id"), "per-vector")
    joined = rows.select("vec_id", "ok", "k1", "k2").where("ok").join(per_vector, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return joined.unionByName(alone).selectExpr("vec_id", "n_links", "component_id", "vec_id <=> component_id as kept")
