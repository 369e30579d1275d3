"""Operator 10: mixing sources to target weights by Pfair scheduling, in built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The queue of sources not named in the weights.
OTHER = "*"
#: Production weights: whole-number shares of the blocks per period.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 3, "src4": 2, OTHER: 10}
#: Documents in a block, and hex digits of a hash by which a source is dealt into parts to be numbered.
BLOCK, DIGITS = 16, 3
#: The columns that tell a row's place.
ADDED = ("mix_queue", "mix_block", "mix_slot", "mix_pos")


def pfair_slots() -> str:
    """SQL for a period's slots, given an array ``a`` of ``struct<queue, w>`` with sum ``total``.

    Job k of a queue with weight w may start at floor(k*total/w) and must end by
    ceil((k+1)*total/w); at each slot the released job with the earliest deadline
    (then the lower index) runs.  The result is the index of the chosen queue per
    slot.
    """
    k = "element_at(acc.k, i + 1)"
    w = "element_at(a, i + 1).w"
    job = f"named_struct('d', ((({k} + 1) * total + {w} - 1) div {w}), 'i', i)"
    ready = f"{k} < {w} AND (({k} * total) div {w}) <= t"
    pick = f"array_min(transform(filter(sequence(0, size(a) - 1), i -> {ready}), i -> {job})).i"
    return f"""aggregate(sequence(0, total - 1),
        named_struct('k', transform(a, x -> 0), 'out', array_repeat(0, 0)),
        (acc, t) -> transform(array({pick}), p -> named_struct(
            'k', transform(acc.k, (x, j) -> x + IF(j = p, 1, 0)), 'out', array_append(acc.out, p)))[0]).out"""


def mix_sources(
    docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block: int = BLOCK, digits: int = DIGITS
) -> DataFrame:
    """A place in the mixed order for every row of ``docs``.

    ``weights`` gives whole-number target shares by source; sources it doesn't
    name (and null) share the queue ``*``, with weight 1 unless given.  Each
    queue's rows, in the order of a hash (MD5) of ``doc_id``, form blocks of
    ``block`` rows.  Time runs in periods of as many slots as the weights of the
    queues that still have blocks add up to; within a period blocks get Pfair
    windows and run earliest deadline first, so while a set of queues lasts every
    prefix holds each queue's share to within less than one block.  When a queue
    runs out, the others go on with their own shares from the next period on; the
    slots that it leaves empty in its last period stay empty, so ``mix_slot`` may skip
    numbers there.  No row is dropped or repeated.

    Rows are numbered in two levels (counts by queue and hash part, then within a
    part), so a source with a third of all rows is spread over 16 ** ``digits`` groups.
    The tables joined to the rows have at most (len(weights) + 1) ** 2 *
    sum(weights) rows, whatever the input, and are broadcast for that reason.

    Adds ``mix_queue``, ``mix_block`` (in its queue, from 0), ``mix_slot`` (global)
    and ``mix_pos`` (in the block).  Rows with one ``doc_id`` go by a hash of the whole
    row, and rows without an id are drawn by that hash alone.  Empty tables give empty results; columns of
    ``docs`` that are named like the added ones are replaced.
    """
    shares = {OTHER: 1} | {str(k): int(v) for k, v in weights.items()}
    if min(shares.values()) < 1 or block < 1 or digits < 1:
        raise ValueError("weights, block and digits must be positive")
    named = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    src = docs["source"].cast("string")
    queue = F.when(src.isin(*[k for k in shares if k != OTHER]), src).otherwise(F.lit(OTHER))
    tie = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if not kind.startswith("map")])
    draw = F.coalesce(F.md5(docs["doc_id"].cast("string")), F.md5(tie.cast("string")))
    rows = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("_row"),
        docs["doc_id"].alias("_id"),
        draw.alias("_draw"),
        tie.alias("_tie"),
        queue.alias("mix_queue"),
        F.substring(draw, 1, digits).alias("_part"),
    )

    counts = rows.groupBy("mix_queue", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_queue", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # one row: the queues, their weights and how many periods they last
    queues = counts.groupBy("mix_queue").agg(F.sum("n").alias("n"))
    queues = queues.select("mix_queue", F.element_at(named, F.col("mix_queue")).alias("w"), "n")
    ends = F.expr(f"(((n + {block - 1}) div {block}) + w - 1) div w")
    all_queues = queues.withColumn("ends", ends).agg(
        F.sort_array(F.collect_list(F.struct(F.col("mix_queue").alias("queue"), "w", "ends"))).alias("qs")
    )
    bounds = "array_sort(array_distinct(transform(qs, q -> q.ends)))"
    phases = (
        all_queues.select("qs", F.expr(bounds).alias("bounds"))
        .select("qs", F.posexplode("bounds").alias("phase", "until"), "bounds")
        .selectExpr(
            "phase",
            "until",
            "IF(phase = 0, 0L, bounds[greatest(phase - 1, 0)]) AS since",
            "filter(qs, q -> q.ends >= until) AS a",
        )
        .selectExpr("*", "aggregate(a, 0, (s, q) -> s + q.w) AS total")
        .selectExpr("phase", "since", "until", "a", "total", f"{pfair_slots()} AS picks")
        .withColumn(
            "base",
            F.coalesce(
                F.sum(F.expr("(until - since) * total")).over(
                    Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("phase", "since", "total", "base", "a", "picks", F.posexplode("picks").alias("at", "pick"))
        .selectExpr(
            "a[pick].queue AS mix_queue",
            "phase AS _phase",
            "size(filter(slice(picks, 1, at), x -> x = pick)) AS _nth",
            "since",
            "total",
            "base",
            "at",
        )
    )
    queue_table = queues.select("mix_queue", "w").crossJoin(all_queues.select(F.expr(bounds).alias("_bounds")))

    order = Window.partitionBy("mix_queue", "_part").orderBy("_draw", "_id", "_tie")
    ranked = (
        rows.withColumn("_rn", F.row_number().over(order))
        .join(starts, ["mix_queue", "_part"])
        .withColumn("_rank", F.expr("_start + _rn - 1"))
        .withColumns({"mix_block": F.expr(f"_rank div {block}"), "mix_pos": F.expr(f"cast(_rank % {block} AS int)")})
        .join(F.broadcast(queue_table), "mix_queue")
        .withColumns({"_period": F.expr("mix_block div w"), "_nth": F.expr("cast(mix_block % w AS int)")})
        .withColumn("_phase", F.expr("size(filter(_bounds, b -> b <= _period))"))
    )
    out = ranked.join(F.broadcast(phases), ["mix_queue", "_phase", "_nth"]).withColumn(
        "mix_slot", F.expr("base + (_period - since) * total + at")
    )
    return out.select("_row.*", *ADDED)


def mixed(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in mixed order, columns unchanged (a range-partitioned sort on the slots)."""
    placed = mix_sources(docs, weights, block)
    return placed.orderBy("mix_slot", "mix_pos").select(*docs.columns)


#: The same with the weights and blocks of the query, slot by slot.
SQL = f"""
WITH RECURSIVE shares(queue, w) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({", ".join(f"'{k}'" for k in WEIGHTS if k != OTHER)}) THEN source ELSE '{OTHER}' END AS queue FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM d),
q AS (SELECT queue, w, ((count(*) + {BLOCK - 1}) // {BLOCK} + w - 1) // w AS ends FROM n JOIN shares USING (queue) GROUP BY queue, w),
ph AS (SELECT ends AS until, row_number() OVER (ORDER BY ends) - 1 AS phase, coalesce(lag(ends) OVER (ORDER BY ends), 0) AS since FROM (SELECT DISTINCT ends FROM q)),
act AS (SELECT phase, since, until, queue, w, row_number() OVER (PARTITION BY phase ORDER BY queue) - 1 AS idx, CAST(sum(w) OVER (PARTITION BY phase) AS BIGINT) AS total FROM ph JOIN q ON q.ends >= ph.until),
jobs AS (SELECT phase, queue, total, k, idx * 1000 + k AS id, (k * total) // w AS release, (((k + 1) * total + w - 1) // w) * 1000 + idx AS urgency FROM (SELECT *, unnest(range(w)) AS k FROM act)),
run(phase, t, done) AS (
    SELECT phase, 0, CAST([] AS BIGINT[]) FROM ph
    UNION ALL
    SELECT r.phase, r.t + 1, list_append(r.done, arg_min(j.id, j.urgency)) FROM run r JOIN jobs j ON j.phase = r.phase AND j.release <= r.t AND r.t < j.total AND NOT list_contains(r.done, j.id)
    GROUP BY r.phase, r.t, r.done),
whole AS (SELECT phase, done FROM run JOIN (SELECT DISTINCT phase, total FROM act) a USING (phase) WHERE t = total),
slots AS (SELECT phase, unnest(done) AS id, unnest(range(len(done))) AS slot FROM whole),
base AS (SELECT phase, since, total, coalesce(sum((until - since) * total) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
         FROM (SELECT DISTINCT phase, since, until, total FROM act)),
b AS (SELECT n.*, place // {BLOCK} AS blk, w FROM n JOIN shares USING (queue)),
c AS (SELECT b.*, (SELECT count(*) FROM ph WHERE until <= b.blk // b.w) AS phase FROM b)
SELECT c.doc_id, c.source, c.queue AS mix_queue, c.blk AS mix_block, CAST(base.base + (c.blk // c.w - base.since) * base.total + slots.slot AS BIGINT) AS mix_slot,
       CAST(c.place % {BLOCK} AS INTEGER) AS mix_pos
FROM c JOIN jobs j ON j.phase = c.phase AND j.queue = c.queue AND j.k = c.blk % c.w JOIN slots ON slots.phase = j.phase AND slots.id = j.id JOIN base ON base.phase = c.phase
"""
