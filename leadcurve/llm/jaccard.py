"""Size-aware heavy-light join of documents by the Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadcurve.llm.blocks import Block, blocks, scramble, sorted_sets, windows
from leadcurve.llm.components import components
from leadcurve.llm.marks import marked_rows
from leadcurve.llm.work import Work, ship, tidy

WORDS = 5
#: The similarity from which documents link, as a fraction: 3 / 4.
SHARED, OF = 3, 4
#: A shingle in more sets than this is ordered last, if the frequency table has room for it.
FREQUENT = 16
FREQUENCY_TABLE = 1 << 18
#: No boundary between small and large sets is looked for beyond this size.
MAX_BOUNDARY = 16
#: A list is kept for another turn, up to so many, while it has more open pairs than this times its sets.
PAIRS_PER_SET, TURNS = 2, 5
#: Shingles, or pairs, that are worked on at once in a task.
UNIT = 250_000


def overlap(a, b):
    """Shared shingles that sets of sizes a and b need: J >= 3/4 is shared >= 3/7 of a + b."""
    return -(-SHARED * (a + b) // (SHARED + OF))


def prefix(n):
    """Of two linked sets, each has one of the other's shingles among so many of its first in any common order."""
    return n - (SHARED * n + OF - 1) // OF + 1


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashed shingles in ascending order, and the number before each text."""
    begin, end, bounds = block.words()
    hashes = block.word_hashes(begin, end)
    grams, at = windows(hashes, bounds, WORDS)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            mixed = np.full(1, bounds[t + 1] - bounds[t], np.uint64)
            for h in hashes[bounds[t] : bounds[t + 1]]:
                mixed = scramble(mixed * np.uint64(0x100000001B3) + h)
            whole[i] = mixed[0]
        grams = np.insert(grams, at[short], whole)
        extra = np.zeros(block.count, np.int64)
        extra[short] = 1
        at = at + np.concatenate(([0], np.cumsum(extra)))
    return sorted_sets(grams, at)


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set; texts with the same set have the same key."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scramble(values ^ np.uint64(0x5851F42D4C957F2D)))))
    key = sums[bounds[1:]] - sums[bounds[:-1]]
    return (scramble(key + np.diff(bounds).astype(np.uint64)) >> np.uint64(1)).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            values, bounds = shingle_sets(block)
            arrays = [batch.column("doc_id").slice(block.first, block.count), pa.array(set_keys(values, bounds)), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "n"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of consecutive texts, about UNIT shingles at once, each set once: values, bounds, keys."""
    kept, total, seen = [], 0, set()

    def unit():
        values = np.concatenate([v for v, _ in kept])
        sizes = np.concatenate([s for _, s in kept])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return values, bounds, set_keys(values, bounds)

    for batch in batches:
        for block in blocks(batch.column("text")):
            values, bounds = shingle_sets(block)
            fresh = []
            for key, n in zip(set_keys(values, bounds).tolist(), np.diff(bounds).tolist(), strict=True):
                fresh.append(n > 0 and key not in seen)
                seen.add(key)
            fresh = np.array(fresh, bool)
            if fresh.any():
                kept.append((values[np.repeat(fresh, np.diff(bounds))], np.diff(bounds)[fresh]))
                total += len(kept[-1][0])
            if total > UNIT:
                yield unit()
                kept, total, seen = [], 0, set()
    if kept:
        yield unit()


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its entries of every column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(first[1:], len(bucket))
    arrays = [pa.array(bucket[first].astype(np.int32))]
    for column in columns:
        data = np.ascontiguousarray(column[order])
        arrays.append(pa.array([data[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *(f"c{i}" for i in range(len(columns)))])


def _split(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the highest bits) and the next 32 bits of hashes."""
    return (values >> np.uint64(64 - bits)).astype(np.int32), (values >> np.uint64(32 - bits)).astype(np.uint32)


def _frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """Rows bucket, key, n: sets with a shingle, for shingles in more than FREQUENT; and with bucket -1 sums of n and of its square."""

    def deal(batches):
        for values, _, _ in _units(batches):
            yield _dealt(*_split(values, bits))

    def count(batches):
        buckets, parts = [], []
        for batch in batches:
            buckets += batch.column("bucket").to_pylist()
            parts += [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("c0")]
        if not parts:
            return
        total = squares = 0
        buckets = np.array(buckets)
        for bucket in np.unique(buckets):
            keys = np.sort(np.concatenate([parts[i] for i in np.flatnonzero(buckets == bucket)]))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys)))
            total, squares = total + int(n.sum()), squares + int((n.astype(np.float64) ** 2).sum())
            many = n > FREQUENT
            columns = [np.full(many.sum(), bucket, np.int32), keys[first][many].astype(np.int64), n[many]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([squares], pa.int64()), pa.array([total], pa.int64())], ["bucket", "key", "n"])

    dealt = docs.mapInArrow(tidy(deal), "bucket int, c0 binary").repartition("bucket")
    return dealt.mapInArrow(tidy(count), "bucket int, key bigint, n bigint")


def _postings(docs: DataFrame, bits: int, frequent: np.ndarray, counts: np.ndarray, least: int) -> DataFrame:
    """The first ``prefix`` shingles of every set of ``least`` or more, rare ones first, dealt by shingle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent, counts))

    def deal(batches):
        known, often = shared.value
        for values, bounds, keys in _units(batches):
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            coarse = values >> np.uint64(32 - bits)
            if len(known):
                at = np.minimum(np.searchsorted(known, coarse), len(known) - 1)
                weight = np.where(known[at] == coarse, often[at], 0)
                order = np.argsort(owner * (int(often.max()) + 1) + weight, kind="stable")
                values = values[order]
            place = np.arange(len(values)) - bounds[owner]
            take = (place < prefix(n)[owner]) & (n[owner] >= least)
            if take.any():
                owner, place = owner[take], place[take]
                wide = np.uint16 if n.max() < 1 << 16 else np.uint32
                bucket, key = _split(values[take], bits)
                out = _dealt(bucket, key, keys[owner], n[owner].astype(wide), place.astype(wide))
                yield out.append_column("width", pa.array(np.full(out.num_rows, np.dtype(wide).itemsize, np.int32)))

    return docs.mapInArrow(tidy(deal), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary, width int").repartition("bucket")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Inverted lists of two or more sets, bucket by bucket: bucket, key, node, n, place, ordered by key and node."""
    rows: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            kind = np.uint16 if r["width"] == 2 else np.uint32
            parts = np.frombuffer(r["c0"], np.uint32), np.frombuffer(r["c1"], np.int64), np.frombuffer(r["c2"], kind), np.frombuffer(r["c3"], kind)
            rows.setdefault(r["bucket"], []).append(parts)
    for bucket in sorted(rows):
        key, node, n, place = (np.concatenate(c) for c in zip(*rows.pop(bucket), strict=True))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node, n, place = key[once], node[once], n[order][once].astype(np.int64), place[order][once].astype(np.int64)
        alone = np.concatenate(([True], key[1:] != key[:-1])) & np.concatenate((key[1:] != key[:-1], [True]))
        yield bucket, key[~alone], node[~alone], n[~alone], place[~alone]


def _starts(*columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], changed))) if len(columns[0]) else np.zeros(0, np.int64)


def _possible(n1, n2, p1, p2):
    """Whether sets that meet at these places of their orders can still share enough."""
    need = overlap(n1, n2)
    return (SHARED * np.maximum(n1, n2) <= OF * np.minimum(n1, n2)) & (p1 <= n1 - need) & (p2 <= n2 - need)


def _pairs(x, y) -> pa.RecordBatch:
    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


MET = "a bigint, b bigint, bucket int, key bigint, node bigint, n bigint, place bigint"


def _met(pairs: pa.RecordBatch | None, *posting: np.ndarray) -> pa.RecordBatch:
    """Pairs, or postings, in the one layout that a pass over lists gives."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    if pairs is not None:
        arrays = [*pairs.columns, *(pa.nulls(pairs.num_rows, k) for k in kinds)]
    else:
        void = pa.nulls(len(posting[0]), pa.int64())
        arrays = [void, void, *(pa.array(c, k) for c, k in zip(posting, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, ["a", "b", "bucket", "key", "node", "n", "place"])


def _stars(boundary: int):
    """Rows of two kinds: pairs of each list's first set with its others, and the lists of three or more."""

    def run(batches):
        for bucket, key, node, n, place in _lists(batches):
            first = _starts(key)
            lengths = np.diff(np.append(first, len(key)))
            centre = np.repeat(first, lengths)
            ok = (np.arange(len(key)) != centre) & _possible(n, n[centre], place, place[centre]) & ~((n <= boundary) & (n[centre] <= boundary))
            pairs = _pairs(node[ok], node[centre][ok])
            if pairs.num_rows:
                yield _met(pairs)
            long = np.repeat(lengths > 2, lengths)
            if long.any():
                yield _met(None, np.full(long.sum(), bucket, np.int32), *(c[long] for c in (key.astype(np.int64), node, n, place)))

    return run


def _across(boundary: int, turn: int):
    """Rows of two kinds: pairs of a list's sets that are still in different components, and lists that stay for the next turn.

    If a list has few such pairs for its length, or it is the last turn, all
    of them that can be similar come out and the list is done. Else one set
    of its largest component, another one in each list and turn, is paired
    with the sets outside that component, most of which it will win over.
    """

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        bucket, key, node, n, place, root = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("bucket", "key", "node", "n", "place", "root"))
        order = np.lexsort((node, root, key, bucket))
        columns = [c[order] for c in (bucket, key, node, n, place, root)]
        bucket, key, node, n, place, root = columns
        lists, runs = _starts(bucket, key), _starts(bucket, key, root)
        if turn < TURNS:
            size, length = np.diff(np.append(runs, len(key))), np.diff(np.append(lists, len(key)))
            own = np.searchsorted(lists, runs, "right") - 1  # the list of a run
            pairs = (length**2 - np.bincount(own, size.astype(np.float64) ** 2, minlength=len(lists))) / 2
            stay = pairs > PAIRS_PER_SET * length
            largest = np.lexsort((-size, own))[_starts(own)]  # the largest run of each list
            draw = scramble(key[lists].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % size[largest].astype(np.uint64)
            pivot = np.repeat(runs[largest] + draw.astype(np.int64), length)
            staying = np.repeat(stay, length)
            ok = staying & (root != root[pivot]) & _possible(n, n[pivot], place, place[pivot]) & ~((n <= boundary) & (n[pivot] <= boundary))
            if ok.any():
                yield _met(_pairs(node[ok], node[pivot[ok]]))
            if stay.any():
                yield _met(None, *(c[staying] for c in columns[:5]))
            bucket, key, node, n, place, root = (c[~staying] for c in columns)
            if not len(key):
                return
            lists, runs = _starts(bucket, key), _starts(bucket, key, root)
        end = np.repeat(np.append(lists[1:], len(key)), np.diff(np.append(lists, len(key))))
        after = np.repeat(np.append(runs[1:], len(key)), np.diff(np.append(runs, len(key))))
        partners = end - after
        at = 0
        while at < len(key):
            ahead = np.cumsum(partners[at:])
            to = at + max(1, int(np.searchsorted(ahead, UNIT)))
            # a list with very many sets is taken in slices of one set's partners
            for lo in range(0, int(partners[at]) if to == at + 1 else 1, UNIT):
                count = np.minimum(partners[at:to] - lo, UNIT) if to == at + 1 else partners[at:to]
                i = np.repeat(np.arange(at, to), count)
                j = np.repeat(after[at:to] + lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                ok = _possible(n[i], n[j], place[i], place[j]) & ~((n[i] <= boundary) & (n[j] <= boundary))
                if ok.any():
                    yield _met(_pairs(node[i[ok]], node[j[ok]]))
            at = to

    return run


def _subsets(boundary: int):
    """Rows key, node, side: subsets by which small sets of two sizes link; sides 0 and 1 are the smaller and the larger size."""

    def run(batches):
        for values, bounds, keys in _units(batches):
            out: list[tuple[int, int, int]] = []
            for node, a, b in zip(keys.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n, members = b - a, values[a:b]
                if n > boundary:
                    continue
                for other in range(-(-SHARED * n // OF), min(boundary, OF * n // SHARED) + 1):
                    low, high, need = min(n, other), max(n, other), int(overlap(n, other))
                    picks = np.array(list(combinations(range(n), need)), np.int64)
                    mixed = np.full(len(picks), low * 64 + high, np.uint64)
                    for column in picks.T:
                        mixed = scramble(mixed * np.uint64(0x100000001B3) + members[column])
                    out += [(k, node, 0 if n == low else 1) for k in mixed.view(np.int64).tolist()]
                    if n == other:
                        out += [(k, node, 1) for k in mixed.view(np.int64).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "node", "side"])

    return run


def _small_links(subsets: DataFrame) -> DataFrame:
    """Sets that have a subset in common link across its two sizes: each with the first set of the other size."""
    first = subsets.groupBy("key").agg(F.expr("min(case when side = 0 then node end) as low"), F.expr("min(case when side = 1 then node end) as high"))
    links = subsets.join(first.where("low is not null and high is not null"), "key")
    return links.selectExpr("node as a", "case when side = 0 then high else low end as b").where("a <> b").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for values, bounds, keys in _units(batches):
        for lo in range(0, len(keys), 2000):
            hi = min(lo + 2000, len(keys))
            members = [values[a:b].tobytes() for a, b in zip(bounds[lo:hi], bounds[lo + 1 : hi + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi]), pa.array(members, pa.binary())], ["node", "members"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(OF * shared >= SHARED * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents named by ``ids``, and perhaps of a few more."""
    return marked_rows(docs, ids).where("marked").select("text")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, work: Work, name: str) -> DataFrame:
    """Pairs (a, b) of sets that are similar, counted on the whole sets."""
    named = pairs.selectExpr("a as node").union(pairs.selectExpr("b as node")).distinct()
    first = nodes.join(named, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = work.keep(_texts_of(docs, first).mapInArrow(tidy(_sets), "node bigint, members binary"), f"{name}-sets")
    with_x = pairs.join(sets.selectExpr("node as a", "members as x"), "a")
    with_y = with_x.join(sets.selectExpr("node as b", "members as y"), "b").select("a", "b", "x", "y")
    links = work.keep(with_y.mapInArrow(tidy(_similar), "a bigint, b bigint"), f"{name}-links")
    work.drop(f"{name}-sets")
    return links


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The size up to which enumerating subsets costs less than scanning the inverted lists of a set's prefix.

    ``sizes``: number of sets by size; ``list_length``: mean length of the
    list behind a posting. Each size costs its count times either its number
    of subsets, or its postings times the list length; the boundary with the
    least sum wins.
    """
    best, least, cost = 0, 0.0, 0.0
    for n in range(1, MAX_BOUNDARY + 1):
        subsets = sum(comb(n, int(overlap(n, t))) for t in range(-(-SHARED * n // OF), OF * n // SHARED + 1))
        cost += sizes.get(n, 0) * (subsets - prefix(n) * (1 + list_length))
        if cost < least:
            best, least = n, cost
    return best


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document by whole-text shingle similarity of 3/4 or more.

    Documents with the same set are one set from the start. Small sets, up to
    a boundary chosen by cost, link by common subsets of the size that each
    pair of sizes needs; such a subset proves the link. For larger ones the
    first shingles of every set, rare before frequent, go into inverted
    lists. Each list's sets are held against its first one; what links is
    joined into components. From then on only pairs of sets of a list that
    are still in different components are looked at, and of these only those
    whose sizes and places in the list leave room for enough shared shingles.
    Lists with many such pairs first take some turns in which one set of the
    largest component meets those outside it; then all pairs left are tried.
    All candidates are counted on whole sets. Nothing is capped: the frequency
    table, of fixed size, only decides the order of shingles, and any order
    gives the same links.

    component_id is the smallest doc_id of the component. A null text, or one
    without a word, has no shingle and links with nothing. Rows with a null
    id link like others; a component of nulls alone has a null id. Repeated
    rows give repeated rows. Only doc_id and text are read.
    """
    placed = _placed(docs, Work(docs.sparkSession, "jaccard"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root", "left").selectExpr("doc_id", "n as n_shingles", "case when n = 0 then doc_id else component_id end as component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of ``link_components``, with all columns: the one with the smallest doc_id.

    Of several rows with that id, null last of all ids, the first by set and text stays. Documents
    without a shingle all stay. Only the rows whose ids the decisions touch
    are shuffled.
    """
    work = Work(docs.sparkSession, "deduplicate")
    placed = _placed(docs, work).where("n > 0")
    ids = placed.groupBy("root", "doc_id").agg(F.count("*").alias("rows"))
    first = ids.groupBy("root").agg(F.min("doc_id").alias("first_id"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "first_id")
    touched = work.keep(placed.join(first, "root").selectExpr("doc_id as own_id", "node as own_node", "root", "doc_id <=> first_id as stays").distinct(), "touched")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    marked = marked_rows(docs.select(row, F.expr("cast(row.doc_id as bigint) as doc_id"), F.expr("cast(row.text as string) as text")), touched.selectExpr("own_id as doc_id"))
    keyed = marked.where("marked").mapInArrow(tidy(_with_node), T.StructType([marked.schema["row"], marked.schema["doc_id"], marked.schema["text"], T.StructField("node", T.LongType())]))
    decided = keyed.join(touched, F.expr("doc_id <=> own_id and node = own_node"), "left").where("root is null or stays")
    once = decided.where("root is not null").withColumn("turn", F.expr("row_number() over (partition by root order by node, xxhash64(text), to_json(row))")).where("turn = 1")
    return marked.where("not marked").select("row.*").unionAll(decided.where("root is null").select("row.*")).unionAll(once.select("row.*"))


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.zeros(0, np.int64)]
        for block in blocks(batch.column("text")):
            keys.append(set_keys(*shingle_sets(block)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "text")), pa.array(np.concatenate(keys))], ["row", "doc_id", "text", "node"])


def _placed(docs: DataFrame, work: Work) -> DataFrame:
    """doc_id, node (its set), n (the set's size) and root (a set of its component) of every row."""
    spark = docs.sparkSession
    ship(spark)
    bits = max(4, min(24, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    texts = docs.select("text").where("text is not null")
    rows = work.keep(docs.mapInArrow(tidy(_profile), "doc_id bigint, node bigint, n bigint"), "rows")
    nodes = rows.where("n > 0")

    frequencies = work.keep(_frequencies(texts, bits), "frequencies")
    total, squares = frequencies.where("bucket < 0").selectExpr("coalesce(sum(n), 0)", "coalesce(sum(key), 0)").first()
    top = frequencies.where("bucket >= 0").orderBy(F.desc("n"), "bucket", "key").limit(FREQUENCY_TABLE).collect()
    table = sorted((r.bucket << 32 | r.key, r.n) for r in top)
    frequent, counts = np.array([k for k, _ in table], np.uint64), np.array([n for _, n in table], np.int64)
    sizes = nodes.where(f"n <= {MAX_BOUNDARY}").groupBy("n").agg(F.countDistinct("node").alias("sets"))
    boundary = choose_boundary({r.n: r.sets for r in sizes.collect()}, squares / max(total, 1))

    small = nodes.where(f"n <= {boundary}").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    subsets = work.keep(_texts_of(docs, small).mapInArrow(tidy(_subsets(boundary)), "key bigint, node bigint, side int").distinct(), "subsets")
    links = work.keep(_small_links(subsets), "small-links")

    least = -(-SHARED * (boundary + 1) // OF)
    postings = _postings(texts, bits, frequent, counts, least)
    met, tried, turn = work.keep(postings.mapInArrow(tidy(_stars(boundary)), MET), "met-0"), None, 0
    while True:
        fresh = met.where("a is not null").select("a", "b").distinct()
        fresh = work.keep(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        tried = fresh if tried is None else tried.union(fresh)
        links = links.union(_verified(docs, nodes, fresh, work, f"turn-{turn}"))
        roots = components(links, work, f"roots-{turn}")
        lists = met.where("node is not null").select("bucket", "key", "node", "n", "place")
        if turn == TURNS or lists.isEmpty():
            break
        turn += 1
        lists = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("bucket", "key")
        met = work.keep(lists.mapInArrow(tidy(_across(boundary, turn)), MET), f"met-{turn}")
        work.drop(f"met-{turn - 1}")

    return work.keep(rows.join(roots, "node", "left").selectExpr("doc_id", "node", "n", "coalesce(root, node) as root"), "placed")
