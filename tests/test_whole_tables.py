"""Queries without SQL, over all rows of a table, held against plain code."""

import datetime
import math
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridweave.api import Grid, GridBatch, JaggedFrame
from gridweave.operators import conv, jagged, metrics, nn, splat_grads, splats
from gridweave.operators.grids import shared_grids
from gridweave.plans import catalog
from gridweave.plans.base import line_grid
from gridweave.plans.list_queries import CAMS
from gridweave.streaming import merge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    return {i: (label, np.array(v, np.float64)) for i, label, v in zip(t["vec_id"], t["label"], t["embedding"])}


def test_a_cone_for_every_point(spark, vectors):
    cells = {}
    for label, v in vectors.values():
        cells.setdefault(label, set()).add(tuple(np.floor(v[:3] / 0.1 + 0.5).astype(int)))
    want = {}
    d = np.array([1.0, 0.01, -0.02])
    for i, (label, v) in vectors.items():
        o = np.array([-6.0, v[1], v[2]])
        box = np.array(sorted(cells[label]))
        a, b = ((box - 0.5) * 0.1 - o) / d, ((box + 0.5) * 0.1 - o) / d
        enter, leave = np.maximum(np.minimum(a, b).max(1), 0.0), np.maximum(a, b).min(1)
        spans = []
        for lo, hi in sorted(zip(enter[leave - enter > 1e-12], leave[leave - enter > 1e-12])):
            if spans and lo <= spans[-1][1] + 1e-9:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        t, size, total, n = 0.0, 0.01, 0.0, 0
        for lo, hi in spans:
            t += math.ceil((lo - t) / size) * size
            if t > hi:
                total, n = total + hi - lo, n + 1
                continue
            edges = [lo] if t - lo > 1e-9 else []
            edges.append(t)
            while t + size < hi:
                t += size
                size = max(t * 0.005, 0.01)
                edges.append(t)
            if hi - t > 1e-9:
                edges.append(hi)
            total, n = total + edges[-1] - edges[0], n + len(edges) - 1
        if n:
            want[label, i] = (n, total)
    got = {}
    for r in catalog.QUERIES["cone_ray_samples"](spark, SF).collect():
        n, total = got.get((r.grid_id, r.ray_id), (0, 0.0))
        got[r.grid_id, r.ray_id] = (n + 1, total + r.t1 - r.t0)
    assert set(got) ^ set(want) == set()
    assert max(i for _, i in want) > len(vectors) - 20  # tilted rays may miss, but not all of the last
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)
    assert np.mean([got[k][0] == want[k][0] for k in want]) > 0.98  # a step may end on an edge


# -- Gaussians -----------------------------------------------------------------------------

CAMERAS = {0: (50.0, np.eye(4)), 1: (40.0, np.array([[0.8, 0, 0.6, 0], [0, 1, 0, 0], [-0.6, 0, 0.8, 0.5], [0, 0, 0, 1]]))}


def shaped(v):
    """Mean, and rotation times scale, of a vector's Gaussian."""
    w, x, y, z = (q := np.array([v[3] + 1, v[4], v[5], v[6]])) / np.linalg.norm(q)
    rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return np.array([v[0] * 3, v[1] * 3, v[2] + 2.5]), rot @ np.diag(np.exp(v[7:10] - 2))


def footprint(v, cam, flat):
    """Position, depth and radii of a Gaussian in a camera, or None where it is culled."""
    f, view = CAMERAS[cam]
    mean, m = shaped(v)
    t = view[:3, :3] @ mean + view[:3, 3]
    if t[2] < 0.01:
        return None
    if flat:
        jac, at = np.array([[f, 0, 0], [0, f, 0]]), f * t[:2] + [32, 24]
    else:
        a = [t[2] * min((n - c) / f + 0.15 * n / f, max(-(c / f + 0.15 * n / f), x / t[2])) for x, c, n in ((t[0], 32, 64), (t[1], 24, 48))]
        jac, at = np.array([[f / t[2], 0, -f * a[0] / t[2] ** 2], [0, f / t[2], -f * a[1] / t[2] ** 2]]), f * t[:2] / t[2] + [32, 24]
    cov = jac @ view[:3, :3] @ m
    cov = cov @ cov.T + 0.3 * np.eye(2)
    radii = np.ceil(3.33 * np.sqrt(np.diag(cov)))
    if np.linalg.det(cov) <= 0 or (at + radii <= 0).any() or (at - radii >= [64, 48]).any():
        return None
    return at, t[2], radii


def same_places(rows, want):
    got = {(r.id, r.cam): (r.mx, r.my, r.depth) for r in rows}
    assert set(got) ^ set(want) == set()
    assert max(i for i, _ in want) > 480
    assert all(np.allclose(got[k], want[k], atol=2e-3) for k in want)


def test_every_gaussian_in_its_scene(spark, vectors):
    want = {(i, i % 2): (*f[0], f[1]) for i, (_, v) in vectors.items() if (f := footprint(v, i % 2, True))}
    same_places(catalog.QUERIES["project_gaussians_by_scene"](spark, SF).collect(), want)


def test_every_gaussian_unscented(spark, vectors):
    lam, want = 0.01 * 3 - 3, {}
    for i, (_, v) in vectors.items():
        mean, m = shaped(v)
        sigma = np.array([mean, *[mean + s * math.sqrt(3 + lam) * m[:, n] for n in range(3) for s in (1, -1)]])
        wm = np.array([lam / (3 + lam), *[0.5 / (3 + lam)] * 6])
        for cam, (f, view) in CAMERAS.items():
            t = sigma @ view[:3, :3].T + view[:3, 3]
            uv = f * t[:, :2] / t[:, 2:] + [32, 24]
            if (t[:, 2] >= 0.01).all() and (uv >= [-6.4, -4.8]).all() and (uv <= [64 * 1.1, 48 * 1.1]).all():
                want[i, cam] = (*(wm @ uv), wm @ t[:, 2])
    same_places(catalog.QUERIES["project_gaussians_unscented"](spark, SF).collect(), want)


def test_every_gaussian_in_world_space(spark, vectors):
    u, v = np.meshgrid(np.arange(64), np.arange(48))
    d = np.stack([(u + 0.5 - 32) / 50, (v + 0.5 - 24) / 50, np.ones_like(u, float)], -1)
    through, opacity, red = np.zeros(u.shape), np.zeros(u.shape), np.zeros(u.shape)
    prints = sorted((f[1], i, f) for i, (_, x) in vectors.items() if (f := footprint(x, 0, False)))
    for _, i, (at, _, radii) in prints:
        x = vectors[i][1]
        mean, m = shaped(x)
        inverse = np.linalg.inv(m)
        o, e = inverse @ -mean, d @ inverse.T
        far = np.maximum(0, o @ o - (e @ o) ** 2 / (e * e).sum(-1))
        alpha = np.minimum(0.99, (0.5 + x[10]) * np.exp(-0.5 * far))
        low, high = np.floor((at - radii) / 16), np.ceil((at + radii) / 16)
        on = (u // 16 >= low[0]) & (u // 16 < high[0]) & (v // 16 >= low[1]) & (v // 16 < high[1]) & (alpha >= 1 / 255)
        after = through + np.where(on, np.log1p(-np.where(on, alpha, 0)), 0)
        weight = np.where(on & (np.exp(after) > 1e-4), alpha * np.exp(through), 0)
        through, opacity, red = after, opacity + weight, red + weight * x[11]
    rows = catalog.QUERIES["rasterize_world_space"](spark, SF).collect()
    assert len(rows) == 64 * 48
    assert all(abs(r.opacity - opacity[r.v, r.u]) < 2e-4 and abs(r.red - red[r.v, r.u]) < 2e-4 for r in rows)


# -- convolution ---------------------------------------------------------------------------


def test_wide_gradients_are_adjoint(spark):
    """<conv x, y> equals <x, conv' y> and <w, gradient by w>, for a strided plan with arrays of 6 and 4 channels."""
    rng = np.random.default_rng(3)
    cells = {tuple(c) for c in rng.integers(-4, 4, (80, 3)).tolist()}
    g = shared_grids(spark.createDataFrame([(0,)], "grid_id int"), spark.createDataFrame([(0, *c) for c in cells], "grid_id int, i int, j int, k int"))
    w = rng.normal(size=(27, 6, 4))
    with conv.ConvPlan.build(g, 3, 2) as plan:
        x = {c: rng.normal(size=6) for c in cells}
        fx = spark.createDataFrame([(0, *c, v.tolist()) for c, v in x.items()], "grid_id int, i int, j int, k int, x array<double>")
        out = {(r.i, r.j, r.k): np.array(r.y) for r in plan.execute_arrays(fx, w).collect()}
        want = {}
        for d in out:
            taps = [((a, b, c), (d[0] * 2 + a - 1, d[1] * 2 + b - 1, d[2] * 2 + c - 1)) for a in range(3) for b in range(3) for c in range(3)]
            want[d] = sum((x[s] @ w[t[0] * 9 + t[1] * 3 + t[2]] for t, s in taps if s in x), np.zeros(4))
        assert all(np.allclose(out[d], want[d]) for d in out)
        y = {d: rng.normal(size=4) for d in out}
        fy = spark.createDataFrame([(0, *d, v.tolist()) for d, v in y.items()], "grid_id int, i int, j int, k int, y array<double>")
        forward = sum(float(out[d] @ y[d]) for d in out)
        back = {(r.i, r.j, r.k): np.array(r.x) for r in plan.input_gradient_arrays(fy, w).collect()}
        assert sum(float(back[c] @ x[c]) for c in cells) == pytest.approx(forward)
        grad = plan.weight_gradient_arrays(fx, fy).collect()
        assert sum(r.w * w[r.tap, r.ci, r.co] for r in grad) == pytest.approx(forward)
        rows = spark.createDataFrame([(int(t), int(a), int(b), float(w[t, a, b])) for t, a, b in np.ndindex(w.shape)], "tap int, ci int, co int, w double")
        again = plan.execute_arrays(fx, rows, bias=[1.0, 0, 0, 0]).collect()
        assert all(np.allclose(np.array(r.y) - [1, 0, 0, 0], out[r.i, r.j, r.k]) for r in again)


def test_many_channels_in_time(spark):
    """64 to 64 channels, 4,096 weights a tap, over the voxels of the line items."""
    began = time.perf_counter()
    g = line_grid(spark, SF)
    x = g.voxels.selectExpr("*", "transform(sequence(0, 63), c -> pmod(i + j * 3 + k * 7 + c, 5) / 4.0D) AS x")
    w = np.random.default_rng(0).normal(size=(27, 64, 64))
    out = conv.ConvPlan.build(g, 3, 1, target=g, keep=False).execute_arrays(x, w).collect()
    assert len(out) == g.voxels.count() and all(len(r.y) == 64 for r in out)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("transposed", [False, True])
def test_layers_over_columns_and_arrays_agree(spark, transposed):
    """The same layer with its channels as columns and as arrays, forward and transposed."""
    rng = np.random.default_rng(5)
    cells = {tuple(c) for c in rng.integers(-3, 4, (40, 3)).tolist()}
    g = shared_grids(spark.createDataFrame([(0,)], "grid_id int"), spark.createDataFrame([(0, *c) for c in cells], "grid_id int, i int, j int, k int"))
    w, bias = rng.normal(size=(27, 2, 3)), (0.5, -1.0, 0.0)
    x = spark.createDataFrame([(0, *c, *rng.normal(size=2).tolist()) for c in cells], "grid_id int, i int, j int, k int, a double, b double")
    rows = spark.createDataFrame([(int(t), int(a), int(b), float(w[t, a, b])) for t, a, b in np.ndindex(w.shape)], "tap int, ci int, co int, w double")
    to, y = nn.SparseConv3d(rows, (3, 3, 3), (2, 2, 2), bias, transposed)(g, x, ("a", "b"), ("p", "q", "r"))
    wide, z = nn.WideConv3d(w, (3, 3, 3), (2, 2, 2), bias, transposed)(g, x.withColumn("x", F.array("a", "b")))
    want = {tuple(r)[:4]: tuple(r)[4:] for r in y.collect()}
    got = {tuple(r)[:4]: r.y for r in z.collect()}
    assert set(got) == set(want) and len(got) == to.voxels.count() == wide.voxels.count()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_plan_policies(spark, monkeypatch):
    g = shared_grids(spark.createDataFrame([(0,)], "grid_id int"), spark.createDataFrame([(0, 0, 0, 0), (0, 5, 0, 0)], "grid_id int, i int, j int, k int"))
    far = g.with_voxels(spark.createDataFrame([(0, 0, 0, 0), (0, 100, 0, 0)], "grid_id int, i int, j int, k int"))
    for kwargs in ({"policy": "restricted"}, {"target": g, "policy": "complete"}, {"policy": "other"}, {"channel_pairs": [(0, 1)]}, {"target": far, "strict": True}):
        with pytest.raises(ValueError):
            conv.ConvPlan.build(g, 3, 1, **kwargs)
    with pytest.warns(UserWarning, match="remainders"):
        conv.ConvPlan.build(g, 1, 2, keep=False)
    plan = conv.ConvPlan.build(g, (3, 3, 1), (1, 1, 1), target=g, policy="restricted", strict=True, channel_pairs=[(2, 5)])
    assert plan.valid_usage(2, 5, (3, 3, 1), 1, False) and not plan.valid_usage(5, 2, (3, 3, 1), 1, False) and not plan.valid_usage(2, 5, 3, 1, False)
    back = plan.reverse()
    assert back.valid_usage(5, 2, (3, 3, 1), 1, True) and back.policy == "restricted"
    with pytest.raises(ValueError, match="not for"):
        plan.execute_arrays(g.voxels.selectExpr("*", "array(1D) AS x"), np.ones((9, 1, 1)))
    monkeypatch.setattr(conv, "BROADCAST_WEIGHTS", 8)
    with pytest.raises(ValueError, match="at most"):
        plan.execute_arrays(g.voxels.selectExpr("*", "array(1D, 2D) AS x"), np.ones((9, 2, 5)))
    plan.release()
    assert not plan.edges.is_cached


# -- single grids, shapes, bytes, late rows ------------------------------------------------


def test_single_grids_take_and_give_rows_without_a_number(spark):
    points = spark.createDataFrame([(n, float(n % 3), float(n % 2), 0.0) for n in range(12)], "point_id long, x double, y double, z double")
    one, batch = Grid.from_points(points, 0.5), GridBatch.from_points(points.withColumn("grid_id", F.lit(0)), 0.5)
    bare = lambda df: sorted(tuple(r) for r in df.drop("grid_id").collect())
    assert "grid_id" not in one.ijk.columns and bare(one.ijk) == bare(batch.ijk)
    assert isinstance(one.dilated_grid(1), Grid) and bare(one.dilated_grid(1).ijk) == bare(batch.dilated_grid(1).ijk)
    f = points.withColumn("f", F.col("point_id").cast("double"))
    fo, fb = one.splat_trilinear(f), batch.splat_trilinear(f.withColumn("grid_id", F.lit(0)))
    assert fo.columns == ["i", "j", "k", "f"] and bare(fo) == bare(fb)
    assert bare(one.sample_trilinear(points, fo)) == bare(batch.sample_trilinear(points.withColumn("grid_id", F.lit(0)), fb))
    coarse, pooled = one.max_pool(fo, 2)
    assert isinstance(coarse, Grid) and "grid_id" not in pooled.columns and bare(pooled) == bare(batch.max_pool(fb, 2)[1])
    assert bare(one.num_voxels) == [(6,)] and one.bboxes.columns == batch.bboxes.drop("grid_id").columns
    back = GridBatch.deserialize(one.to_gridbatch().serialize())
    assert back.is_same(batch).first()[0]


def test_shapes_and_casts(spark):
    j = JaggedFrame.from_lists(spark, [[[1.5, -2.5], []], [[3.0]]], depth=2)
    assert tuple(j.sizes().first()) == (2, 3, 3, 2)
    assert {r.outer_idx: r.lshape for r in j.lshape().collect()} == {0: [2, 0], 1: [1]}
    assert j.eshape().first()[0] is None and tuple(j.rshape().first()) == (3, None)
    arrays = JaggedFrame(j.rows.withColumn("v", F.array("v", "v")))
    assert arrays.eshape().first()[0] == 2 and tuple(arrays.rshape().first()) == (3, 2)
    with pytest.raises(Exception, match="different shapes"):
        JaggedFrame(j.rows.withColumn("v", F.when(F.col("row_idx") == 0, F.array("v")).otherwise(F.array("v", "v")))).eshape().collect()
    for cast, kind, want in (("int", int, [1, -2, 3]), ("long", int, [1, -2, 3]), ("float", float, [1.5, -2.5, 3.0]), ("double", float, [1.5, -2.5, 3.0]), ("bool", bool, [True] * 3)):
        got = [r.v for r in getattr(j, cast)().rows.orderBy("outer_idx", "row_idx").collect()]
        assert got == want and all(type(v) is kind for v in got)
    assert [r.v for r in arrays.int().rows.orderBy("outer_idx", "row_idx").collect()] == [[1, 1], [-2, -2], [3, 3]]


def test_offsets_of_uneven_lists(spark):
    rng = np.random.default_rng(6)
    offsets = [0, 0, 1, 2, 2, 3, 700, 701, 701, 1000]
    data = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    ids = [(n // 3, n % 3) for n in range(9)]
    got = sorted(tuple(r) for r in jagged.from_offsets(data, offsets, list_ids=ids).collect())
    assert got == sorted((*ids[n], p - a, p * 2) for n, (a, b) in enumerate(zip(offsets, offsets[1:])) for p in range(a, b))
    n = [(int(o), int(i), int(x)) for (o, i), x in zip({(int(a) * 5000, int(b)) for a, b in rng.integers(-20, 20, (60, 2))}, rng.integers(0, 9, 60))]
    shape = spark.createDataFrame(n, "outer_idx int, inner_idx int, n long")
    begin, want = 0, []
    for o, i, x in sorted(n):
        want.append((o, i, begin, begin + x))
        begin += x
    assert sorted(tuple(r) for r in jagged.joffsets(shape).collect()) == want


def test_rows_that_come_too_late_are_dropped(spark, tmp_path):
    """A stream in four files: the watermark passes a window's end two files before one of its rows arrives."""
    hour = lambda h, n: (0, float(n), 0.0, 0.0, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), 1.0)
    files = [[hour(0.5, 0), hour(1.5, 0)], [hour(9, 0), hour(1.6, 0)], [hour(8.9, 0)], [hour(0.7, 0), hour(30, 0)]]
    schema = "grid_id int, x double, y double, z double, ts timestamp, value double"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    out = merge.windowed_moments(stream, ("value",), "ts", "1 hour", "2 hours")
    q = out.writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window.start.hour: r.n for r in spark.table("late_rows").collect() if r.window.start.day == 1}
    # 00:42 came after the watermark had passed 07:00; 01:36 and 08:54 were in time
    assert got == {0: 1, 1: 2, 8: 1, 9: 1}


# -- gradients of splats --------------------------------------------------------------------


def scene_of(vectors, n):
    """A few Gaussians in front of the cameras, as flat parameters: mean, quaternion, log scale."""
    return {i: np.concatenate([[v[0] * 3, v[1] * 3, v[2] + 2.5], [v[3] + 1, *v[4:7]], v[7:10] - 2]) for i, (_, v) in list(vectors.items())[:n]}


def as_frame(spark, rows):
    return spark.createDataFrame([(int(i), p[:3].tolist(), p[3:7].tolist(), p[7:].tolist()) for i, p in rows], "id long, mean array<double>, quat array<double>, log_scale array<double>")


@pytest.mark.parametrize("flat", [False, True])
def test_projection_gradients_by_differences(spark, vectors, flat):
    """Every parameter of some Gaussians is moved a little; all moved copies are projected at once."""
    step, scene = 1e-5, scene_of(vectors, 12)
    scene[900] = np.array([3.0, 0.2, 2.0, 1, 0.2, -0.1, 0.3, -1, -2, -1.5])  # beyond the field of view, where the slope is held
    moved = [(i * 100 + n * 2 + (s > 0), p + s * step * (np.arange(10) == n)) for i, p in scene.items() for n in range(10) for s in (-1, 1)]
    weights = {c: 0.3 + 0.2 * k for k, c in enumerate(splat_grads.FOOT)}
    foot = splats.project(as_frame(spark, moved), CAMS, (64, 48), keep_culled=True, orthographic=flat)
    loss = {}
    for r in foot.collect():
        loss[r.id] = loss.get(r.id, 0.0) + sum(w * r[c] for c, w in weights.items())
    grads = spark.createDataFrame([(c, int(i)) for c in CAMS for i in scene], "cam int, id long").withColumns({"g_" + c: F.lit(w) for c, w in weights.items()})
    got = {r.id: [*r.g_mean, *r.g_quat, *r.g_log_scale] for r in splat_grads.project_backward(as_frame(spark, scene.items()), grads, CAMS, (64, 48), orthographic=flat).collect()}
    assert set(got) == set(scene)
    for i in scene:
        want = [(loss[i * 100 + n * 2 + 1] - loss[i * 100 + n * 2]) / (2 * step) for n in range(10)]
        assert np.allclose(got[i], want, rtol=1e-4, atol=1e-4), (i, got[i], want)


def world_image(params, opacity, red, order, reach, d):
    """Red and opacity of each pixel by blending along its ray; what a Gaussian may touch and the order are given."""
    through, total, shade = np.ones(d.shape[:2]), np.zeros(d.shape[:2]), np.zeros(d.shape[:2])
    for i in order:
        w, x, y, z = (q := params[i][3:7]) / np.linalg.norm(q)
        rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        into = np.linalg.inv(rot @ np.diag(np.exp(params[i][7:])))
        o, e = into @ -params[i][:3], d @ into.T
        alpha = np.where(reach[i], np.minimum(0.99, opacity[i] * np.exp(-0.5 * (o @ o - (e @ o) ** 2 / (e * e).sum(-1)))), 0)
        shade, total = shade + through * alpha * red[i], total + through * alpha
        through = through * (1 - alpha)
    return shade, total


def test_world_gradients_by_differences(spark, vectors):
    params, size = scene_of(vectors, 6), (32, 16)
    opacity, red = {i: 0.2 + 0.05 * n for n, i in enumerate(params)}, {i: 0.3 * n - 0.5 for n, i in enumerate(params)}
    u, v = np.meshgrid(np.arange(32), np.arange(16))
    d = np.stack([(u + 0.5 - 16) / 25, (v + 0.5 - 8) / 25, np.ones_like(u, float)], -1)
    rays = spark.createDataFrame([(0, int(a), int(b), 0.0, 0.0, 0.0, *map(float, d[b, a])) for a in range(32) for b in range(16)], "cam int, u int, v int, ox double, oy double, oz double, dx double, dy double, dz double")
    order = sorted(params, key=lambda i: params[i][2])
    foot = spark.createDataFrame([(0, int(i), 16.0, 8.0, float(n), 99, 99, opacity[i], red[i]) for n, i in enumerate(order)], "cam int, id long, mx double, my double, depth double, radius_x int, radius_y int, opacity double, red double")
    g = as_frame(spark, params.items())
    told = splats.world_contributions(g, foot, rays, size, ("red",)).select("id", "u", "v").collect()
    reach = {i: np.zeros((16, 32), bool) for i in params}
    for r in told:
        reach[r.id][r.v, r.u] = True
    gr, go = (u % 5 - 2) / 4.0, (v % 3) / 2.0
    grads = spark.createDataFrame([(0, int(a), int(b), float(gr[b, a]), float(go[b, a])) for a in range(32) for b in range(16)], "cam int, u int, v int, g_red double, g_opacity double")
    out = {r.id: r for r in splat_grads.rasterize_world_backward(g, foot, rays, grads, size, ("red",)).collect()}

    def loss(p, o=opacity, c=red):
        shade, total = world_image(p, o, c, order, reach, d)
        return float((shade * gr + total * go).sum())

    assert len(out) == len(params)
    for i in params:
        want = []
        for n in range(10):
            up, down = ({**params, i: params[i] + s * 1e-6 * (np.arange(10) == n)} for s in (1, -1))
            want.append((loss(up) - loss(down)) / 2e-6)
        assert np.allclose([*out[i].g_mean, *out[i].g_quat, *out[i].g_log_scale], want, rtol=1e-3, atol=1e-4)
        for name, values in (("g_opacity", "o"), ("g_red", "c")):
            base = opacity if values == "o" else red
            up, down = ({**base, i: base[i] + s * 1e-6} for s in (1, -1))
            assert out[i][name] == pytest.approx((loss(params, **{values: up}) - loss(params, **{values: down})) / 2e-6, rel=1e-3, abs=1e-5)


def test_harmonics_gradient_by_differences(spark):
    rng = np.random.default_rng(2)
    v, sh, g, step = rng.normal(size=(4, 3)), rng.normal(size=(2, 25)), [0.7, -0.4], 1e-5
    rows = [(n * 10 + m * 2 + (s > 0), *(v[n] + s * step * (np.arange(3) == m)).tolist()) for n in range(4) for m in range(3) for s in (-1, 1)]
    frame = lambda r: spark.createDataFrame(r, "id long, vx double, vy double, vz double").withColumns({"sh": F.array(*[F.array(*map(F.lit, c.tolist())) for c in sh]), "g_color": F.array(*map(F.lit, g))})
    loss = {r.id: sum(a * b for a, b in zip(g, r.color)) for r in splats.evaluate_harmonics(frame(rows), 4).collect()}
    for r in splat_grads.harmonics_backward(frame([(n, *v[n].tolist()) for n in range(4)]), 4).collect():
        want = [(loss[r.id * 10 + m * 2 + 1] - loss[r.id * 10 + m * 2]) / (2 * step) for m in range(3)]
        assert np.allclose([r.g_vx, r.g_vy, r.g_vz], want, atol=1e-5)
        assert np.allclose(np.array(r.g_sh[0]) * g[1], np.array(r.g_sh[1]) * g[0])


def test_similarity_gradient_by_differences(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((13, 14)), rng.random((13, 14))
    at = [(0, 0), (6, 7), (12, 13), (5, 3)]
    rows = [(0, 0, y, x, float(a[y, x]), float(b[y, x])) for y in range(13) for x in range(14)]
    for n, (p, q) in enumerate(at):
        for s in (0, 1):
            rows += [(1 + n * 2 + s, 0, y, x, float(a[y, x]) + (1e-5 if s else -1e-5) * ((y, x) == (p, q)), float(b[y, x])) for y in range(13) for x in range(14)]
    px = spark.createDataFrame(rows, "image int, c int, y int, x int, a double, b double")
    for padding in ("same", "valid"):
        mean = {r.image: r.m for r in metrics.ssim_map(px, padding).groupBy("image").agg(F.avg("ssim").alias("m")).collect()}
        got = {(r.y, r.x): r.g_a for r in metrics.ssim_backward(px.where("image = 0"), padding).collect()}
        assert len(got) == 13 * 14
        for n, p in enumerate(at):
            assert got[p] == pytest.approx((mean[2 + n * 2] - mean[1 + n * 2]) / 2e-5, abs=1e-6)


def test_similarity_does_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(n, c, y, x, *rng.random(2).tolist()) for n, (h, w) in enumerate(((23, 31), (8, 8), (3, 40))) for c in range(2) for y in range(h) for x in range(w)]
    rows[300] = (*rows[300][:4], math.nan, 0.5)
    px = spark.createDataFrame(rows, "image int, c int, y int, x int, a double, b double")
    at = lambda df, v: {tuple(r)[:4]: r[v] for r in df.collect()}
    for padding in ("same", "valid"):
        got = []
        for side, cells in ((64, 1 << 18), (8, 1 << 18), (64, 1)):
            monkeypatch.setattr(metrics, "TILE", side)
            monkeypatch.setattr(metrics, "CELLS", max(cells, 4))
            got.append((at(metrics.ssim_map(px, padding), "ssim"), at(metrics.ssim_backward(px, padding), "g_a")))
        for other in got[1:]:
            for a, b in zip(got[0], other):
                assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-12, nan_ok=True) for k, v in a.items())
        assert len(got[0][1]) == len(rows) and 0 < sum(map(math.isnan, got[0][0].values())) <= 121
    plan = metrics.ssim_backward(px)._jdf.queryExecution().optimizedPlan().toString()
    assert "_t.w" not in plan and plan.count("Repartition") == 1  # a pixel is sent once, not to each of its window's places


# -- lenses and shutters ------------------------------------------------------------------------


def seen_at(point, start, end, share):
    """A point in the camera's space, with the rotation between two views taken along the shorter way."""
    def quat(r):
        w = math.sqrt(max(0, 1 + np.trace(r))) / 2
        return np.array([w, (r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w)])

    a, b = quat(start[:3, :3]), quat(end[:3, :3])
    q = a + share * ((b if a @ b >= 0 else -b) - a)
    w, x, y, z = q / np.linalg.norm(q)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return r @ point + start[:3, 3] + share * (end[:3, 3] - start[:3, 3])


@pytest.mark.parametrize("shutter,lens", [("vertical", False), ("horizontal", True)])
def test_rolling_shutter_against_loops(spark, vectors, shutter, lens):
    k = [0.1, -0.02, 0.003, 0, 0, 0, 0.004, -0.003, 0.002, 0.001, -0.001, 0.002]
    start, end = np.eye(4), np.eye(4)
    end[:3, :3] = [[math.cos(0.2), 0, math.sin(0.2)], [0, 1, 0], [-math.sin(0.2), 0, math.cos(0.2)]]
    end[:3, 3] = [0.1, -0.05, 0.2]
    lam, want = 0.01 * 3 - 3, {}

    def pixel(p, share):
        x, y, z = seen_at(p, start, end, share)
        if z <= 1e-6:
            return None
        x, y = x / z, y / z
        if lens:
            r2 = x * x + y * y
            radial = 1 + k[0] * r2 + k[1] * r2**2 + k[2] * r2**3
            x, y = x * radial + 2 * k[6] * x * y + k[7] * (r2 + 2 * x * x) + k[8] * r2 + k[9] * r2**2, y * radial + k[6] * (r2 + 2 * y * y) + 2 * k[7] * x * y + k[10] * r2 + k[11] * r2**2
        return np.array([50 * x + 32, 50 * y + 24])

    inside = lambda px: px is not None and -6.4 <= px[0] < 64 * 1.1 and -4.8 <= px[1] < 48 * 1.1

    def rolled(p):
        a, b = pixel(p, 0.0), pixel(p, 1.0)
        if not inside(a) and not inside(b):
            return None
        at = a if inside(a) else b
        for _ in range(6):
            at = pixel(p, min(1, max(0, math.floor(at[1]) / 47 if shutter == "vertical" else math.floor(at[0]) / 63)))
            if not inside(at):
                return None
        return at

    for i, (_, v) in vectors.items():
        mean, m = shaped(v)
        points = [mean, *[mean + s * math.sqrt(3 + lam) * m[:, n] for n in range(3) for s in (1, -1)]]
        px = [rolled(p) for p in points]
        depth = seen_at(mean, start, end, 0.5)[2]
        if all(p is not None for p in px) and depth >= 0.01:
            want[i] = (*(np.array([lam / (3 + lam), *[0.5 / (3 + lam)] * 6]) @ np.array(px)), depth)
    g = as_frame(spark, scene_of(vectors, len(vectors)).items())
    out = splats.project_unscented(g, {0: ([[50, 0, 32], [0, 50, 24], [0, 0, 1]], start)}, (64, 48), shutter=shutter, last_views={0: end}, model="radtan_thin_prism_9" if lens else "pinhole", distortion={0: k} if lens else None)
    got = {r.id: (r.mx, r.my, r.depth) for r in out.collect()}
    assert len(want) > 300 and set(want) ^ set(got) == set()
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
