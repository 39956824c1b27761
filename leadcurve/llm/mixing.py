"""Mixing sources to target weights by hash thresholds, without sorting the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm.work import Work

#: Java regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
HASH_BITS = 60
LEVEL_BITS = 12


SOURCE = "coalesce(concat('=', source), 'null') as src"
SIZE = f"cast(coalesce(regexp_count(text, r'{WORD}'), 0) as bigint) as size"
TIMES = "every + cast(hash <= cut as bigint)"


def _hash(seed: str) -> str:
    text = f"concat_ws('|', '{seed}', coalesce(cast(doc_id as string), ''), coalesce(text, ''))"
    return f"cast(conv(substring(md5({text}), 1, {HASH_BITS // 4}), 16, 10) as bigint) as hash"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """Targets of the sources: ``share`` of all sizes, dealt by weight, at most ``epochs`` times a source's size.

    ``sizes`` has one row per source: source, src, source_size. Sources
    in code-point order, null last, take the weights in turn. Resharing what
    is above a cap until none is above ends at target = min(cap, level *
    weight); in ascending order of cap / weight the capped sources come
    first, so running sums give the level in one pass over the sources.
    """
    listed = sizes.select(
        "*",
        F.expr(f"element_at(array({','.join(f'{w}D' for w in weights)}), cast((row_number() over (order by source asc nulls last) - 1) % {len(weights)} as int) + 1) as weight"),
        F.expr(f"cast({epochs} * source_size as double) as cap"),
        F.expr(f"{share}D * sum(source_size) over () as budget"),
    )
    levels = listed.select(
        "*",
        F.expr("cap / weight as turn"),
        F.expr(
            "(budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0D))"
            " / sum(weight) over (order by cap / weight desc, source desc nulls first rows between unbounded preceding and current row) as level"
        ),
    )
    return levels.select(
        "source", "src", "source_size",
        F.expr("least(cap, weight * coalesce(max(case when level <= turn then level end) over (), 1e300D)) as target"),
    )


def _thresholds(sized: DataFrame, work: Work, weights, share, epochs) -> DataFrame:
    """One row per source: src, source_size, target, every (full copies), cut (highest hash taken once more), and shared, part.

    ``shared`` is the hash that several rows have of which ``part`` are taken once more, null if there is none.
    """
    sizes = sized.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
    targets = work.keep(source_targets(sizes, weights, share, epochs), "targets")
    every = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select(
        "src",
        every.cast("long").alias("every"),
        (F.col("target") - every * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("below"),
    )
    for known in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = work.keep(_refined(sized, state, known), f"level-{known}")
        if state.where("spread").isEmpty():
            break
    # as many of the boundary's rows as come nearest to the rest; half a row counts as one
    part = "case when rest <= 0 then 0 when inside <= 0 then members else least(greatest(cast(floor((rest - below) / (inside / members) + 0.5) as bigint), 0), members) end"
    cuts = state.selectExpr("src", "every", "rest", "low", "members", f"{part} as part").selectExpr(
        "src", "every",
        "case when rest <= 0 then -1 when part = members then low else low - 1 end as cut",
        "case when part > 0 and part < members then low end as shared",
        "part",
    )
    return work.keep(targets.join(cuts, "src").select("src", "source_size", "target", "every", "cut", "shared", "part"), "limits")


def _with_times(rows: DataFrame, limits: DataFrame, work: Work) -> DataFrame:
    """The rows (src, hash and others) joined with their source's limits, and times.

    Rows that share the boundary hash are alike; where only a part of them is
    taken they are counted by task, and each task is told how many of its
    own to take, so none of them has to be brought together.
    """
    joined = rows.join(limits, "src").withColumn("times", F.expr(TIMES))
    if limits.where("shared is not null").isEmpty():
        return joined
    alike = work.keep(joined.where("hash <=> shared").withColumn("number", F.monotonically_increasing_id()), "alike")
    task, within = "shiftright(number, 33)", f"number & {(1 << 33) - 1}L"
    counts = alike.groupBy("src", F.expr(f"{task} as task")).agg(F.expr("count(*) as here"), F.expr("max(part) as part"))
    shares = counts.selectExpr("src as own_src", "task", "part - (sum(here) over (partition by src order by task) - here) as left")
    taken = alike.join(shares, F.expr(f"src = own_src and {task} = task")).withColumn("times", F.expr(f"every + cast({within} < left as bigint)"))
    return joined.where("not (hash <=> shared)").unionAll(taken.select(joined.columns))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times.

    A source with target t and size s takes every document floor(t / s)
    times, and once more those whose hash is not above the source's
    threshold. The threshold is found by histograms: sizes summed by source
    and hash bucket; the bucket in which the budget ends is the boundary, and
    only its rows are dealt into finer buckets, until it holds one hash
    value. Of its rows, one or several alike, as many are taken as come
    nearest to the target.

    The hash covers doc_id and text, so only rows alike in both share it;
    which of them are taken is left open. All other rows part, also those
    with a null id or source. Null or empty texts have size 0 and cost
    nothing. An empty table gives no rows. Other columns are not read.
    Windows without a partition run over the sources, one row each, which a
    corpus has few of.
    """
    work = Work(docs.sparkSession, "mix")
    sized = work.keep(docs.selectExpr("doc_id", "source", SOURCE, SIZE, _hash(seed)), "sized")
    limits = _thresholds(sized, work, weights, share, epochs)
    return _with_times(sized, limits, work).select("doc_id", "source", "size", "source_size", "target", "times")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed=SEED) -> DataFrame:
    """The documents as often as ``mix`` takes them, with the columns they came with."""
    work = Work(docs.sparkSession, "mixed")
    sized = work.keep(docs.selectExpr("source", SOURCE, SIZE, _hash(seed)), "sized")
    limits = _thresholds(sized, work, weights, share, epochs)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = _with_times(docs.select(row, F.expr(SOURCE), F.expr(_hash(seed))), limits, work)
    return rows.select("row", F.explode(F.expr("array_repeat(true, cast(times as int))"))).select("row.*")


def _refined(sized: DataFrame, state: DataFrame, known: int) -> DataFrame:
    """The boundary bucket of every source with ``known`` low bits left open, looked for inside the last one."""
    upper = known + LEVEL_BITS
    buckets = (
        sized.join(state.select("src", "prefix"), "src")
        .where(F.shiftright("hash", upper) == F.col("prefix"))
        .groupBy("src", F.shiftright("hash", known).alias("bucket"))
        .agg(F.sum("size").alias("inside"), F.count("*").alias("members"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    )
    totals = buckets.join(state.select("src", "every", "rest", "below"), "src").selectExpr(
        "src", "every", "rest", "bucket", "inside", "members", "low", "high",
        "below + sum(inside) over (partition by src order by bucket) as upto",
        "row_number() over (partition by src order by bucket desc) as back",
    )
    # rounding may put the rest at the very end: the last bucket is the boundary then
    hit = totals.where("upto > rest or back = 1")
    first = hit.groupBy("src").agg(F.min_by(F.struct("every", "rest", "bucket", "inside", "members", "low", "high", "upto"), "bucket").alias("b"))
    return first.selectExpr("src", "b.every as every", "b.rest as rest", "b.bucket as prefix", "b.upto - b.inside as below", "b.inside as inside", "b.members as members", "b.low as low", "b.low < b.high and b.rest > 0 as spread")
