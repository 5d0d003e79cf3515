"""The boundary library and masks against plain loops; edges of set operations, windows, shapes and stores."""

import itertools
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from motrac.operators import boundary, cells, embed, library, lineage, motion, stats
from motrac.plans import library_queries, registry
from motrac.sources import frames
from motrac.sources.scratch import scratch_path


def _points(spark):
    """Two frames of a ring of twelve points that moves by one, and a second ring near it in frame 0 only."""
    ring = [(3 * math.cos(2 * math.pi * k / 12), 3 * math.sin(2 * math.pi * k / 12), 0.0) for k in range(12)]
    rows = [(f, 1, 1, [x + f, y, z]) for f in (0, 1) for x, y, z in ring] + [(0, 2, 2, [x + 7, y, z]) for x, y, z in ring]
    return ring, spark.createDataFrame(rows, "frame int, index long, state int, pt array<double>")


def test_boundary_library_follows_points(spark):
    ring, points = _points(spark)
    got = library.boundary_library(points, knn=5).collect()
    assert len(got) == 36
    for r in got:
        one = r["index"] == 1
        assert (r["dx_next"] is not None) == (one and r["frame"] == 0) and (r["dx_prev"] is not None) == (one and r["frame"] == 1)
        for d in (r["dx_next"], r["dx_prev"]):
            assert d is None or d == pytest.approx([1.0, 0.0, 0.0])
        other = [(x + (7 if one else 0), y, z) for x, y, z in ring]
        want = min(math.dist(r["pt"], q) for q in other)
        near = r["near"] or {}
        assert near == (pytest.approx({2 if one else 1: want}) if r["frame"] == 0 and want <= 10 else {})


def test_library_properties_equal_sums(spark):
    ring, points = _points(spark)
    lib = library.boundary_library(points, knn=5)
    rows = lib.collect()
    got = {(r["frame"], r["index"]): r for r in library.library_properties(lib, [1, 2]).collect()}
    assert set(got) == {(0, 1), (1, 1), (0, 2)}
    for key, p in got.items():
        own = [r for r in rows if (r["frame"], r["index"]) == key]
        middle = np.mean([r["pt"] for r in own], axis=0)
        far = [math.dist(r["pt"], middle) for r in own]
        volume = boundary.hull_volume(np.array([[x, y, z + d] for x, y, z in (r["pt"] for r in own) for d in (-0.5, 0.5)]))
        radius = (3 * volume / (4 * math.pi)) ** (1 / 3)
        assert p["radius"] == pytest.approx(radius) and volume == pytest.approx(12 / 2 * 9 * math.sin(math.pi / 6))
        charges = {
            "near_1": [2 * (1 / r["near"][1] - 0.5) if r["near"] and 1 in r["near"] else None for r in own],
            "near_2": [2 * (1 / r["near"][2] - 0.5) if r["near"] and 2 in r["near"] else None for r in own],
            "dx_prev": [r["dx_prev"] and float(np.dot(r["dx_prev"], r["n"])) for r in own],
            "dx_next": [r["dx_next"] and -float(np.dot(r["dx_next"], r["n"])) for r in own],
            "curvature": [r["c"] for r in own],
            "shape": [f - radius for f in far],
        }
        for name, q in charges.items():
            known = [(v, r["pt"]) for v, r in zip(q, own) if v is not None]
            if not known:
                assert p[f"l0_{name}"] is None and p[f"l1_{name}"] is None
                continue
            center = np.mean([x for _, x in known], axis=0)
            first = np.mean([v * (np.array(x) - center) for v, x in known], axis=0)
            assert p[f"l0_{name}"] == pytest.approx(np.mean([v for v, _ in known])) and p[f"l1_{name}"] == pytest.approx(np.linalg.norm(first) / 3, abs=1e-9)
    none = library.boundary_library(points.limit(0))
    assert none.count() == 0 and library.library_properties(none, [1]).count() == 0


def _parts(on):
    """Parts that hold together at sides, as sets of places."""
    left, out = {tuple(p) for p in np.argwhere(on)}, []
    while left:
        part, front = set(), [left.pop()]
        while front:
            y, x = front.pop()
            part.add((y, x))
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in left:
                    left.remove(q)
                    front.append(q)
        out.append(part)
    return out


def test_probability_mask_equals_loops(spark):
    rng = np.random.default_rng(7)
    p = rng.random((2, 14, 12)).cumsum(2) % 1.0
    rows = [(f, x, y, float(p[f, y, x])) for f, y, x in itertools.product(range(2), range(14), range(12))]
    px = spark.createDataFrame([*rows, (1, 12, 0, None)], "frame int, x int, y int, p double")
    for area, growth in ((0, 0), (4, 0), (4, 1)):
        got = {(r["frame"], r["x"], r["y"]): r["on"] for r in cells.probability_mask(px, "p", 0.45, area, growth).collect()}
        assert got[1, 12, 0] in (True, False) and len(got) == len(rows) + 1
        for f in range(2):
            on = np.zeros((14, 13), bool)
            there = np.zeros((14, 13), bool)
            on[:, :12], there[:, :12] = p[f] > 0.45, True
            there[0, 12] = f == 1
            if area:
                for kind in (True, False):
                    for part in _parts((on == kind) & there):
                        if len(part) < area:
                            for q in part:
                                on[q] = not kind
            for k in range(2 * growth):
                new = on.copy()
                for y, x in np.argwhere(there):
                    near = [on[q] for q in ((y, x), (y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if 0 <= q[0] < 14 and 0 <= q[1] < 13 and there[q]]
                    new[y, x] = any(near) if k < growth else all(near)
                on = new
            assert all(v == on[y, x] for (g, x, y), v in got.items() if g == f)


def test_set_operations_windows_and_pivots_with_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "v string, k int")
    assert [tuple(r) for r in lineage.common_rows(a, b, ["k", "v"]).collect()] == [(None, "y"), (1, "x")]
    assert lineage.common_rows(a, b.limit(0), ["k", "v"]).count() == 0
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 1, 4.0), (1, 5, 8.0), (2, 0, None)], "traj_id int, frame int, x double")
    got = sorted((r["traj_id"], r["frame"], r["mean"], r["n"]) for r in motion.centred_mean(s, "x", 2).collect() if r["traj_id"] == 1)
    assert got == [(1, 0, 3.0, 2), (1, 1, 3.0, 2), (1, 1, 3.0, 2), (1, 5, 8.0, 1)]
    long = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, "other", 1.0), (2, None, 1.0)], "k int, name string, v double")
    assert sorted(tuple(r) for r in stats.wide(long, ["k"], "name", "v", ["a", "b"]).collect()) == [(1, 5.0, None), (2, None, None)]


def test_sequences(spark):
    rows = [([1, 2, 3], [0, 1, 2, 3], True), ([1, 3], [1, 2, 3], False), ([], [1], True), ([1, 2], [1], False), ([12], [1, 2], False)]
    got = spark.createDataFrame(rows, "sub array<int>, full array<int>, want boolean").select("want", lineage.sequence_in(F.col("sub"), F.col("full")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_registration_by_points_finds_a_turned_scaled_cloud(spark):
    rng = np.random.default_rng(4)
    first = rng.random((9, 2)) * 100
    turn = 1.01 * np.array([[math.cos(0.02), -math.sin(0.02)], [math.sin(0.02), math.cos(0.02)]])
    second = (first - [1.0, -0.5]) @ np.linalg.inv(turn).T
    rows = [(0, k, *map(float, p)) for k, p in enumerate(first)] + [(1, k, *map(float, p)) for k, p in enumerate(second)] + [(2, 0, 5.0, 5.0)]
    got = {r["frame"]: (r["tx"], r["ty"]) for r in motion.point_registration(spark.createDataFrame(rows, "frame int, label int, x double, y double")).collect()}
    assert got[0] == (0, 0) and got[1] == pytest.approx((1.0, -0.5), abs=1e-6) and got[2] == (0, 0)


def test_distance_store_refuses_and_replaces_rows(spark, tmp_path):
    rows = lambda values: spark.createDataFrame(values, "i long, j long, d double")
    path = f"file://{tmp_path}/d"
    embed.store_distances(rows([(0, 1, 2.0), (1, 0, 4.0)]), path)
    with pytest.raises(ValueError):
        embed.store_distances(rows([(1, 0, 9.0)]), path)
    embed.store_distances(rows([(600, 0, 1.0)]), path)
    embed.store_distances(rows([(1, 0, 8.0)]), path, overwrite=True)
    assert sorted(tuple(r) for r in embed.load_distances(spark, path, False).collect()) == [(0, 1, 2.0), (1, 0, 8.0), (600, 0, 1.0)]
    assert sorted(tuple(r) for r in embed.load_distances(spark, path).collect()) == [(0, 1, 5.0), (0, 600, 1.0), (1, 0, 5.0), (600, 0, 1.0)]


def test_vector_store_equals_distance_store(spark, tmp_path):
    """Rows replaced by other vectors, other columns, repeated and missing numbers, rows without a vector: all as if the distances themselves were stored."""
    rng = np.random.default_rng(3)
    points = lambda ids: spark.createDataFrame([(i, None if i % 17 == 5 else rng.normal(size=3).tolist()) for i in ids], "cell_id long, xf array<double>")
    first, second = points([*range(40), 7, 2**40]), points([*range(20, 60), 7, -3])
    numbers, vectors = f"file://{tmp_path}/d", f"file://{tmp_path}/v"

    def both(a, b, **kw):
        embed.store_distances(embed.distance_rows(a, b), numbers, **kw)
        embed.store_points(a, b, vectors, **kw)

    def same():
        for symmetrize in (True, False):
            want = sorted(tuple(r) for r in embed.load_distances(spark, numbers, symmetrize).collect())
            got = sorted(tuple(r) for r in embed.load_points(spark, vectors, symmetrize, block=16).collect())
            assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])

    both(first.where("cell_id < 30"), first)
    same()
    for a, b in ((first.where("cell_id = 3"), first), (second.where("cell_id = 21"), second)):
        with pytest.raises(ValueError):
            embed.store_points(a, b, vectors)
    both(first.where("cell_id >= 30"), first)
    both(second.where("cell_id in (5, 22, 25, 39, 50) or cell_id < 10"), second, overwrite=True)
    both(first.where("cell_id = 25"), second.limit(0), overwrite=True)
    same()
    assert {r["set"]: r["n"] for r in spark.read.parquet(f"{vectors}/columns").groupBy("set").agg(F.count("*").alias("n")).collect()} == {0: first.where("xf is not null").count(), 1: second.where("xf is not null").count()}


def test_stored_distances_writes_no_square(spark, sf_dir, monkeypatch):
    """Before, each distance was shuffled, written twice and shuffled again to meet its mirror."""
    made = []
    monkeypatch.setattr(library_queries, "scratch_path", lambda spark, tag: made.append(scratch_path(spark, tag)) or made[-1])
    df = library_queries.stored_distances(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert sum(r["n"] for r in spark.read.option("recursiveFileLookup", True).parquet(made[0]).groupBy("cell_id").agg(F.count("*").alias("n")).collect()) == 2 * n + 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
    assert df.count() == n * n


def test_plain_rounding_equals_rounding(spark):
    values = [0.0, 1 / 128, 2.5, 0.4999995, 1.0000005, 123.4567895, 1e-7, 5e-7, 999999999.9999999, 1e9, 3.3e17, float("inf")]
    got = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "d double").select(registry.r("d"), registry.r_plain("d")).collect()
    assert all(a == b or a != a and b != b for a, b in got)


def test_tables_metadata_and_treatments(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert [frames.save_table(df, path), frames.save_table(df, path), frames.save_table(df, path, True)] == [0, 1, 0]
    values = {"channels": ["a", "b"], "scale": 0.5, "nested": {"x": {"y": [1, 2]}}, "none": None}
    frames.save_metadata(spark, values, f"{path}-m")
    assert frames.load_metadata(spark, f"{path}-m") == values
    with pytest.raises(AnalysisException):
        frames.save_metadata(spark, values, f"{path}-m")
    both = frames.treatments({"b": df, "a": df.drop("v")}).collect()
    assert sorted((r["treatment"], r["v"]) for r in both) == [("a", None), ("b", "a")] or {(r["treatment"], r["v"]) for r in both} == {("a", None), ("b", "a")}
    with pytest.raises(ValueError):
        frames.treatments({})


def test_frames_are_added_replaced_and_refused(spark, tmp_path):
    px = spark.createDataFrame([(f, x, 0, f * 10 + x) for f in (0, 1) for x in (0, 1)], "frame int, x int, y int, label int")
    path = f"file://{tmp_path}/movie"
    frames.write_frames(px, path)
    with pytest.raises(AnalysisException):
        frames.append_frame(px, path, 1)
    frames.append_frame(px.withColumn("label", F.lit(7)), path, 1, overwrite=True)
    frames.append_frame(px.withColumn("frame", F.col("frame") + 2), path, 2)
    got = sorted((r["frame"], r["label"]) for r in frames.read_frames(spark, path).collect())
    assert got == [(0, 0), (0, 1), (1, 7), (1, 7), (2, 0), (2, 1)]
    shape = cells.image_shape(px.withColumn("z", F.lit(3)), []).where("frame = 0").first()
    assert tuple(shape) == (0, "zxy", 2, 1, 4, 0)


def test_foreground_order_of_sources(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 0.0, False), (0, 1, 0, 0, 5.0, True), (0, 2, 0, None, None, None)], "frame int, x int, y int, label int, c double, foreground boolean")
    on = lambda **kw: [r["fg"] for r in cells.foreground(px, **kw).orderBy("x").collect()]
    assert on(mask="label", channel="c", threshold=1.0) == [True, False, False] and on(channel="c", threshold=1.0) == [False, True, False] and on() == [False, True, False]


def test_nearest_of_states_over_tiles(spark):
    """Points on both sides of a tile's edge, within reach and not, each written to the tiles in reach only; before, to 27 places."""
    rng = np.random.default_rng(6)
    rows = [(f, int(i), int(i) % 3, [float(v) for v in rng.uniform(-20, 20, 3)]) for f in range(2) for i in rng.integers(0, 7, 60)]
    rows += [(3, 1, 0, [16.0, 0.0, 0.0]), (3, 2, 1, [14.0, 0.0, 0.0]), (3, 3, 2, [18.0, 0.0, 0.0]), (3, 4, 2, [20.5, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "frame int, index long, state int, pt array<double>")
    near = library.near_states(points, 2.0)
    got = {(r["frame"], r["index"], tuple(r["pt"])): r["near"] for r in near.collect()}
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] and a[1] != b[1] and (d := math.dist(a[3], b[3])) <= 2:
            own = want.setdefault((a[0], a[1], tuple(a[3])), {})
            own[b[2]] = min(d, own.get(b[2], 9))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and got[3, 1, (16.0, 0.0, 0.0)] == {1: 2.0, 2: 2.0}
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()


def test_a_library_is_gone_through_once(spark, sf_dir):
    """Normals, both transports and the shape take one pass over the clouds each; before, there were several, and each border was found anew."""
    from motrac.plans import catalog

    plan = catalog.queries()["library_properties"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and plan.count("FlatMapGroupsInPandas") == 2 and "Window" not in plan
