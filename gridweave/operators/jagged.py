"""Jagged lists as rows ``outer_idx, inner_idx, row_idx, values...``: building, reshaping, indexing, reducing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grids import MAX_LISTED, check_columns, running_sums, tasks_for

#: Outer list, list in it, position in that list.
LIST = ["outer_idx", "inner_idx"]
ROW = [*LIST, "row_idx"]
#: Keys of a list that a query meets at once.
PIECE = 256
STRUCTURE_SCHEMA = "outer_idx int, inner_idx int, n long"


# -- building ---------------------------------------------------------------------


def from_lists(spark: SparkSession, lists: Sequence, depth: int = 1, kind: str = "double") -> DataFrame:
    """A list of lists of values (``depth`` 1), or lists of those (``depth`` 2), as rows with value ``v``."""
    outer = [[x] for x in lists] if depth == 1 else lists
    rows = [(o, n, r, v) for o, inner in enumerate(outer) for n, x in enumerate(inner) for r, v in enumerate(x)]
    return spark.createDataFrame(rows, f"outer_idx int, inner_idx int, row_idx long, v {kind}")


def structure_of(spark: SparkSession, sizes: Sequence, depth: int = 1) -> DataFrame:
    """Lists and their lengths, empty ones too: ``outer_idx, inner_idx, n``."""
    outer = [[x] for x in sizes] if depth == 1 else sizes
    return spark.createDataFrame([(o, n, x) for o, inner in enumerate(outer) for n, x in enumerate(inner)], STRUCTURE_SCHEMA)


def structure(jt: DataFrame) -> DataFrame:
    """Lists that have rows, and how many."""
    return jt.groupBy(*LIST).agg(F.count("*").alias("n"))


def from_indices(data: DataFrame, index: str = "jidx", order: str = "pos") -> DataFrame:
    """Rows with the number of their list, in the order of ``order``, as a jagged relation."""
    check_columns(data, index, order)
    rest = [c for c in data.columns if c not in (index, order)]
    n = (F.row_number().over(Window.partitionBy(index).orderBy(order)) - 1).cast("long")
    return data.select(F.col(index).cast("int").alias("outer_idx"), F.lit(0).alias("inner_idx"), n.alias("row_idx"), *rest)


def from_offsets(data: DataFrame, offsets: Sequence[int], order: str = "pos", list_ids: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Rows numbered by ``order``, cut at offsets; ``list_ids`` names the lists' places, else they are outer lists."""
    if any(b < a for a, b in zip(offsets, offsets[1:])) or not offsets or offsets[0] != 0:
        raise ValueError("offsets must start at 0 and not fall")
    ids = list_ids or [(n, 0) for n in range(len(offsets) - 1)]
    # a row finds its list by an equi-join on a bucket of positions; lists and buckets are about as many
    width = max(1, offsets[-1] // max(1, len(ids)))
    spans = [
        (bucket, o, n, a, b)
        for (o, n), a, b in zip(ids, offsets, offsets[1:])
        if a < b
        for bucket in range(a // width, (b - 1) // width + 1)
    ]
    listed = data.sparkSession.createDataFrame(spans, "_bucket long, outer_idx int, inner_idx int, _a long, _b long")
    hint = F.broadcast if len(spans) <= MAX_LISTED else (lambda d: d)
    rest = [c for c in data.columns if c != order]
    rows = check_columns(data, order).withColumn("_bucket", F.expr(f"{order} div {width}L"))
    j = rows.join(hint(listed), "_bucket").where((F.col(order) >= F.col("_a")) & (F.col(order) < F.col("_b")))
    return j.select(*LIST, (F.col(order) - F.col("_a")).alias("row_idx"), *rest)


def filled(shape: DataFrame, how: str = "zeros", seed: int = 0) -> DataFrame:
    """A jagged relation of the lengths ``n`` of ``shape``: ``zeros``, ``ones``, ``empty`` (null), ``rand`` or ``randn``."""
    value = {"zeros": F.lit(0.0), "ones": F.lit(1.0), "empty": F.lit(None).cast("double"), "rand": F.rand(seed), "randn": F.randn(seed)}
    if how not in value:
        raise ValueError(f"unknown filling {how!r}")
    rows = shape.where("n > 0").select(*LIST, F.explode(F.expr("sequence(0L, n - 1)")).alias("row_idx"))
    return rows.withColumn("v", value[how])


# -- structure ----------------------------------------------------------------------


def joffsets(shape: DataFrame) -> DataFrame:
    """Where each list's rows begin and end when all lists stand one after the other."""
    s = running_sums(shape, "outer_idx", LIST, "n", "begin")
    return s.select(*LIST, "begin", (F.col("begin") + F.col("n")).alias("end"))


def jidx(jt: DataFrame, shape: DataFrame) -> DataFrame:
    """Each row with the number of its list among all lists, and its number among all rows."""
    lists = running_sums(shape, "outer_idx", LIST, "n", "begin", "jidx").withColumn("jidx", F.col("jidx").cast("int")).drop("n")
    return jt.join(lists, LIST).withColumn("pos", F.col("begin") + F.col("row_idx")).drop("begin")


def jflatten(jt: DataFrame, dim: int = 0) -> DataFrame:
    """One list of all rows (``dim`` 0) or one per outer list (``dim`` 1), in order."""
    if dim not in (0, 1):
        raise ValueError("dim must be 0 or 1")
    shape = structure(jt)
    if dim == 0:
        lists = running_sums(shape, "outer_idx", LIST, "n", "_b").drop("n")
    else:
        w = Window.partitionBy("outer_idx").orderBy("inner_idx").rowsBetween(Window.unboundedPreceding, -1)
        lists = shape.select(*LIST, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_b"))
    outer = F.lit(0) if dim == 0 else F.col("outer_idx")
    rest = [c for c in jt.columns if c not in ROW]
    return jt.join(lists, LIST).select(outer.alias("outer_idx"), F.lit(0).alias("inner_idx"), (F.col("_b") + F.col("row_idx")).alias("row_idx"), *rest)


def sizes(jt_shape: DataFrame) -> DataFrame:
    """One row: ``num_lists`` (outer lists), ``num_tensors`` (all lists), ``num_rows``, and whether lists are nested (``ldim`` 1 or 2)."""
    nested = F.coalesce(F.max("inner_idx") > 0, F.lit(False))
    return jt_shape.agg(
        F.count_distinct("outer_idx").alias("num_lists"), F.count("*").alias("num_tensors"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"), F.when(nested, 2).otherwise(1).alias("ldim"),
    )


def lshape(shape: DataFrame) -> DataFrame:
    """The lengths of each outer list's lists, in order, as an array."""
    items = F.sort_array(F.collect_list(F.struct("inner_idx", "n")))
    return shape.groupBy("outer_idx").agg(F.transform(items, lambda s: s["n"]).alias("lshape"))


def eshape(jt: DataFrame, value: str = "v") -> DataFrame:
    """One row: the length of the rows' feature arrays (null for plain values); rows that differ raise."""
    if not dict(jt.dtypes)[value].startswith("array"):
        return jt.limit(0).agg(F.lit(None).cast("int").alias("eshape"))
    size = F.size(value)
    differ = F.raise_error(F.lit("rows of different shapes")).cast("int")
    return jt.agg(F.when(F.coalesce(F.min(size) == F.max(size), F.lit(True)), F.max(size)).otherwise(differ).alias("eshape"))


def rshape(jt: DataFrame, value: str = "v") -> DataFrame:
    """One row: all rows and the length of their feature arrays, the shape of the data laid end to end."""
    return eshape(jt, value).crossJoin(F.broadcast(jt.agg(F.count("*").alias("num_rows")))).select("num_rows", "eshape")  # one row each


def cast(jt: DataFrame, kind: str, value: str = "v") -> DataFrame:
    """The values as another type: ``int``, ``long``, ``float``, ``double``, ``boolean``; arrays element by element."""
    inner = dict(jt.dtypes)[value].startswith("array")
    return jt.withColumn(value, F.col(value).cast(f"array<{kind}>" if inner else kind))


def jreshape(jt: DataFrame, shape: DataFrame) -> DataFrame:
    """The rows in order, in lists of the lengths of ``shape``."""
    flat = jflatten(jt).drop(*LIST)
    spans = joffsets(shape)
    rest = [c for c in flat.columns if c != "row_idx"]
    # an equi-join on the position: each list names its own rows
    rows = spans.where("end > begin").select(*LIST, "begin", F.explode(F.expr("sequence(begin, end - 1)")).alias("_p"))
    return rows.join(flat, rows["_p"] == flat["row_idx"]).select(*LIST, (F.col("_p") - F.col("begin")).alias("row_idx"), *rest)


def jsqueeze(jt: DataFrame, value: str = "v") -> DataFrame:
    """Feature arrays of one element as plain values."""
    return jt.withColumn(value, F.when(F.size(value) == 1, F.col(value)[0]).otherwise(F.raise_error(F.lit("more than one element")).cast("double")))


def jcat(parts: Sequence[DataFrame], dim: int | None = None, value: str = "v") -> DataFrame:
    """Concatenation: of the lists (None), of rows list by list (0), or of feature arrays (1)."""
    out = parts[0]
    for p in parts[1:]:
        if dim is None:
            shift = out.agg(F.coalesce(F.max("outer_idx") + 1, F.lit(0)).alias("_s"))
            out = out.unionByName(p.crossJoin(F.broadcast(shift)).withColumn("outer_idx", F.col("outer_idx") + F.col("_s")).drop("_s"))
        elif dim == 0:
            n = structure(out).withColumnRenamed("n", "_n")
            moved = p.join(n, LIST, "left").withColumn("row_idx", F.col("row_idx") + F.coalesce("_n", F.lit(0))).drop("_n")
            out = out.unionByName(moved)
        elif dim == 1:
            out = out.join(p.withColumnRenamed(value, "_w"), ROW).withColumn(value, F.concat(value, "_w")).drop("_w")
        else:
            raise ValueError("dim must be None, 0 or 1")
    return out


def jpick(jt: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Outer lists by number, in the order given."""
    order = jt.sparkSession.createDataFrame([(int(x), n) for n, x in enumerate(ids)], "outer_idx int, _new int")
    j = jt.join(F.broadcast(order) if len(ids) <= MAX_LISTED else order, "outer_idx")
    return j.withColumn("outer_idx", F.col("_new")).drop("_new").select(*jt.columns)


def jindex(jt: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by list-local numbers: ``index`` has ``outer_idx, inner_idx, row_idx`` and the number ``v`` (negative: from the end)."""
    n = structure(jt).withColumnRenamed("n", "_n")
    at = index.join(n, LIST, "left").select(*ROW, F.when(F.col("v") < 0, F.col("v") + F.col("_n")).otherwise(F.col("v")).cast("long").alias("_at"))
    rest = [c for c in jt.columns if c not in ROW]
    src = jt.select(*LIST, F.col("row_idx").alias("_at"), *rest)
    return at.join(src, [*LIST, "_at"]).select(*ROW, *rest)


def rmask(jt: DataFrame, mask: DataFrame, keep: str = "keep") -> DataFrame:
    """Rows whose mask is true, numbered anew in their lists."""
    rest = [c for c in jt.columns if c not in ROW]
    kept = jt.join(mask.where(F.col(keep)).select(*ROW), ROW, "left_semi")
    n = (F.row_number().over(Window.partitionBy(*LIST).orderBy("row_idx")) - 1).cast("long")
    return kept.select(*LIST, n.alias("row_idx"), *rest)


def unbind(jt: DataFrame, value: str = "v") -> DataFrame:
    """One array for each list."""
    items = F.sort_array(F.collect_list(F.struct("row_idx", value)))
    return jt.groupBy(*LIST).agg(F.transform(items, lambda s: s[value]).alias(value))


# -- reductions -----------------------------------------------------------------------


def jsum(jt: DataFrame, shape: DataFrame | None = None, value: str = "v") -> DataFrame:
    """Sum of each list; 0 for the empty ones of ``shape``."""
    s = jt.groupBy(*LIST).agg(F.sum(value).alias("sum"))
    return s if shape is None else shape.select(*LIST).join(s, LIST, "left").select(*LIST, F.coalesce("sum", F.lit(0.0)).alias("sum"))


def _extreme(jt: DataFrame, shape: DataFrame | None, value: str, largest: bool) -> DataFrame:
    # one aggregate, combined before the shuffle: the extreme value and, among equals, the last position
    key = F.struct(value, "row_idx") if largest else F.struct((-F.col(value)).alias("_m"), "row_idx")
    s = jt.groupBy(*LIST).agg(F.max(F.struct(key.alias("k"), F.col(value).alias("v"), F.col("row_idx").alias("r"))).alias("b"))
    s = s.select(*LIST, F.col("b.v").alias("value"), F.col("b.r").cast("long").alias("index"))
    if shape is None:
        return s
    out = shape.select(*LIST).join(s, LIST, "left")
    return out.select(*LIST, F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("index", F.lit(-1).cast("long")).alias("index"))


def jmax(jt: DataFrame, shape: DataFrame | None = None, value: str = "v") -> DataFrame:
    """Largest value of each list and its last position; value 0 and position -1 for empty lists."""
    return _extreme(jt, shape, value, True)


def jmin(jt: DataFrame, shape: DataFrame | None = None, value: str = "v") -> DataFrame:
    """Smallest value of each list and its last position; value 0 and position -1 for empty lists."""
    return _extreme(jt, shape, value, False)


def jargsort(jt: DataFrame, value: str = "v", descending: bool = False) -> DataFrame:
    """For each list the positions in sorted order: ``rank`` and ``row_idx``."""
    by = F.col(value).desc() if descending else F.col(value).asc()
    rank = (F.row_number().over(Window.partitionBy(*LIST).orderBy(by, "row_idx")) - 1).cast("long")
    return jt.select(*LIST, rank.alias("rank"), "row_idx")


# -- pairs of relations -----------------------------------------------------------------


def combine(a: DataFrame, b: DataFrame, op, value: str = "v", strict: bool = False) -> DataFrame:
    """``op`` of the values of equal rows; if ``strict``, rows of one side alone raise."""
    right = b.select(*ROW, F.col(value).alias("_w"))
    if not strict:
        return a.join(right, ROW).select(*ROW, op(F.col(value), F.col("_w")).alias(value))
    j = a.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), ROW, "full")
    bad = F.raise_error(F.lit("the lists differ in structure")).cast("double")
    return j.select(*ROW, F.when(F.col("_l") & F.col("_r"), op(F.col(value), F.col("_w"))).otherwise(bad).alias(value))


def attention(q: DataFrame, k: DataFrame, v: DataFrame, scale: float | None = None) -> DataFrame:
    """Scaled dot-product attention within each list: arrays ``v`` of queries, keys and values.

    Weights are softmaxed with the largest score taken off.  Keys and values meet in
    pieces of ``PIECE`` neighbouring rows of a list.  A query meets each piece of its list as one
    row and keeps the largest score, the sum of weights and the weighted sums; these are put together
    over the pieces.  Lists are dealt over tasks in proportion to the queries and keys.
    """
    n = tasks_for(q, max(q.count(), k.count()))
    kv = k.select(*ROW, F.col("v").alias("_k")).repartition(n, *ROW).join(v.select(*ROW, F.col("v").alias("_v")).repartition(n, *ROW).hint("merge"), ROW)
    piece = F.floor(F.col("row_idx") / PIECE).alias("_p")
    kv = kv.repartition(n, *LIST).groupBy(*LIST, piece).agg(F.sort_array(F.collect_list(F.struct("row_idx", "_k", "_v"))).alias("_l"))
    own = q.select(*ROW, F.col("v").alias("_q")).repartition(n, *LIST)
    j = own.join(kv.hint("merge"), LIST)
    dot = "aggregate(zip_with(_q, x._k, (a, b) -> a * b), 0.0D, (s, y) -> s + y)"
    factor = F.lit(scale) if scale is not None else 1 / F.sqrt(F.size("_q").cast("double"))
    s = j.withColumn("_f", factor).withColumn("_s", F.expr(f"transform(_l, x -> {dot} * _f)")).withColumn("_m", F.array_max("_s"))
    s = s.withColumn("_e", F.expr("transform(_s, x -> exp(x - _m))"))
    one = "zip_with(_l, _e, (x, e) -> transform(x._v, y -> y * e))"
    s = s.withColumn("_o", F.expr(one)).select(*ROW, "_p", "_m", F.expr("aggregate(_e, 0.0D, (s, x) -> s + x)").alias("_t"), _sums("_o", "x", "x").alias("_w"))
    out = s.groupBy(*ROW).agg(F.max("_m").alias("_m"), F.sort_array(F.collect_list(F.struct("_p", F.col("_m").alias("m"), "_t", "_w"))).alias("_l"))
    total = "aggregate(_l, 0.0D, (s, x) -> s + x._t * exp(x.m - _m))"
    sums = _sums("_l", "transform(x._w, y -> y * exp(x.m - _m))", "transform(_l[0]._w, y -> y * exp(_l[0].m - _m))")
    return out.withColumn("_w", sums).withColumn("_t", F.expr(total)).select(*ROW, F.expr("transform(_w, y -> y / _t)").alias("v"))


def _sums(rows: str, each: str, first: str) -> Column:
    """Sums, channel by channel, of an array of arrays, in order."""
    first = f"{rows}[0]" if first == "x" else first
    return F.expr(f"aggregate(slice({rows}, 2, size({rows})), {first}, (s, x) -> zip_with(s, {each}, (a, y) -> a + y))")
