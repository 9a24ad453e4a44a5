"""Adaptive grid, exact kernels, overlay, suppression in ranges, GeoJSON of every kind."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import kernels, overlay, spatial
from tilewright.operators import vector
from tilewright.plans import components
from tilewright.queries import fixtures
from tilewright.sources import readers, sinks

RING = "array<struct<x:double,y:double>>"
BOXES = "id long, minx double, miny double, maxx double, maxy double"


def meet(p, q):
    return p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]


@pytest.mark.parametrize("limit", [1, 40, 1 << 22])
def test_box_pairs(spark, limit):
    """The same pairs whether cells are cut, dealt into blocks, or left alone."""
    r = random.Random(9)
    some = lambda n, k: [(k + i, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.choice([0, 1, 7, 70, 900, 9000]), y + r.choice([0, 2, 30, 2000])) for i in range(n)]
    stacked = [(500 + i, 3.0, 4.0, 3.0, 4.0) for i in range(20)] + [(600 + i, 5.0, 5.0, 5.5, 5.5) for i in range(20)]
    a, b = some(50, 0) + stacked + [(900, None, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)], some(60, 1000) + stacked
    want = sorted((p[0], q[0]) for p in a for q in b if None not in p and meet(p, q))
    left, right = spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES)
    assert sorted(tuple(x) for x in spatial.box_pairs(left, right, 2.0, pair_limit=limit, depth=3).collect()) == want
    both = sorted((p[0], q[0]) for p in b for q in b if p[0] < q[0] and meet(p, q))
    assert sorted(tuple(x) for x in spatial.box_pairs(right, right, 2.0, same=True, pair_limit=limit, depth=3).collect()) == both
    tagged = lambda d: d.withColumn("img", F.when(F.col("id") % 5 > 0, F.col("id") % 3))
    per_image = sorted((p, q) for p, q in want if p % 5 and q % 5 and p % 3 == q % 3)
    assert sorted(tuple(x) for x in spatial.box_pairs(tagged(left), tagged(right), 2.0, by="img", pair_limit=limit, depth=2).collect()) == per_image
    assert spatial.box_pairs(left.limit(0), right, 2.0).count() == 0


def test_crowded_spots_are_cut(spark):
    """100,000 small boxes on 10 spots far smaller than a cell: no key holds more than a twentieth of the candidate rows."""
    n = 100_000
    spot = F.col("id") % 10
    u = lambda k: (F.xxhash64(F.lit(k), "id") % 1000003 / 1000003.0).cast("double")
    d = spark.range(n).select("id", (spot * 1000.0 + u(1)).alias("minx"), (spot * 77.0 + u(2)).alias("miny")).withColumns({"maxx": F.col("minx") + 0.002, "maxy": F.col("miny") + 0.002})
    seen = []
    real = spatial._test

    def spy(a, b, key, cell, same):
        seen.append((a.groupBy(*key).count(), b.groupBy(*key).count(), key))
        return real(a, b, key, cell, same)

    spatial._test = spy
    try:
        found = spatial.box_pairs(d, d, 100.0, same=True, pair_limit=1 << 20).count()
    finally:
        spatial._test = real
    sizes = [r["count"] for a, _, _ in seen for r in a.collect()]
    assert max(sizes) <= 0.05 * sum(sizes)
    rows = d.toPandas()
    want = 0
    for _, g in rows.groupby(rows.id % 10):
        x, y = g.minx.to_numpy(), g.miny.to_numpy()
        order = np.argsort(x)
        x, y = x[order], y[order]
        for k in range(len(x)):
            e = np.searchsorted(x, x[k] + 0.002, "right")
            want += int((np.abs(y[k + 1 : e] - y[k]) <= 0.002).sum())
    assert abs(found - want) <= 2


def random_parts(r, areal):
    return [[(float(r.randrange(12)), float(r.randrange(12))) for _ in range(r.randrange(0, 6))] for _ in range(r.randrange(0, 3))]


@pytest.mark.parametrize(("a_areal", "b_areal"), [(True, True), (True, False), (False, False)])
def test_kernels_equal_expressions(spark, a_areal, b_areal):
    """The array kernels and the column expressions agree on random lines and areas: lone points, empty parts, shared edges, nulls."""
    r = random.Random(4)
    rows = [(i, None if r.random() < 0.05 else random_parts(r, a_areal), None if r.random() < 0.05 else random_parts(r, b_areal)) for i in range(600)]
    d = spark.createDataFrame(rows, f"i int, a array<{RING}>, b array<{RING}>")
    want = {x.i for x in d.where(G.intersects(F.col("a"), F.col("b"), a_areal, b_areal)).select("i").collect()}
    got = {x.i for x in kernels.keep_intersecting(d, "a", "b", a_areal, b_areal).collect()}
    assert got == want and 50 < len(want) < 550
    assert kernels.keep_intersecting(d, "a", "b", a_areal, b_areal, drop=False).columns == ["i", "a", "b"]


def test_kernels_in_chunks(monkeypatch):
    r = np.random.default_rng(3)
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    column = lambda: pa.array([[[{"x": x, "y": y} for x, y in r.uniform(0, 6, (5, 2)).tolist()]] for _ in range(300)], kind)
    a, b = (kernels.Flat.of(column(), True) for _ in range(2))
    whole = kernels.intersecting(a, b, True, True)
    monkeypatch.setattr(kernels, "AT_ONCE", 3)
    assert (kernels.intersecting(a, b, True, True) == whole).all()


def test_features_of_equal_shapes(spark, monkeypatch):
    """All pairs and the same survivors however many features share a shape; a shape is tested once with another, and shapes without points meet nothing, not even each other."""
    r = random.Random(8)
    some = [[[(x := float(r.randrange(40)), y := float(r.randrange(40))), (x + 6, y + 1), (x + 2, y + 5)]] for _ in range(12)] + [[], None, [[(1.0, 1.0)]]]
    rows = [(i, r.choice(some)) for i in range(150)] + [(None, some[0])]
    d = spark.createDataFrame(rows, f"id long, parts array<{RING}>")
    seen, whole, shapes = [], vector.keep_intersecting, vector._shapes
    monkeypatch.setattr(vector, "keep_intersecting", lambda both, *x: seen.append(both.count()) or whole(both, *x))
    monkeypatch.setattr(vector, "_shapes", lambda f: shapes(f, 4))
    other = d.where("id is not null").select(F.col("id").alias("i"), F.col("parts").alias("p"))
    met = d.where("id is not null").crossJoin(other).where(G.intersects(F.col("parts"), F.col("p"), True, True))
    want = sorted((q.id, q.i) for q in met.select("id", "i").collect())
    assert sorted(map(tuple, vector.meeting(d, d, 4.0, True, True).collect())) == want and max(seen) <= len(some) ** 2 < len(want)
    later = [(a, b) for a, b in want if a < b]
    assert sorted(map(tuple, vector.meeting(d, d, 4.0, True, True, same=True).collect())) == later
    gone = set()
    for a, b in later:
        gone |= {b} if a not in gone else set()
    assert sorted(q.id for q in vector.suppress(d, 4.0, areal=True).collect()) == [i for i, _ in rows if i is not None and i not in gone]


def test_shapes_of_larger_tables_lie_denser(spark):
    """The fields of triangles and lines do not grow with their tables, so no pair of far ids is left out."""
    part, orders = (spark.range(1, 30_001).select(F.col("id").alias(c)) for c in ("p_partkey", "o_orderkey"))
    for name, table, key in (("triangles", "part", part), ("bent_lines", "orders", orders)):
        assert spark.sql(fixtures.SQL[name], **{table: key}).agg(F.max("x1")).first()[0] < 420


def test_tiles_of_shapes(spark):
    r = random.Random(2)
    rows = [(i, [[(r.uniform(-30, 30), r.uniform(-30, 30)) for _ in range(3)]]) for i in range(60)] + [(100, None), (101, []), (102, [[(10.0, 10.0)]])]
    d = spark.createDataFrame(rows, f"id long, parts array<{RING}>")
    got = {(x.id, x.tx, x.ty) for x in vector.tiles_met(d, 10, True).collect()}
    tiles = spark.createDataFrame([(x, y) for x in range(-4, 4) for y in range(-4, 4)], "tx long, ty long")
    x, y = F.col("tx") * 10.0, F.col("ty") * 10.0
    met = d.crossJoin(tiles).where(G.intersects(F.col("parts"), F.array(G.box_ring(x, y, x + 10, y + 10)), True, True))
    want = {(q.id, q.tx, q.ty) for q in met.select("id", "tx", "ty").collect()}
    assert got == want and {(102, 0, 0), (102, 1, 1), (102, 0, 1), (102, 1, 0)} <= got


# --- overlay -----------------------------------------------------------------------------------------------
def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], dtype=float)


def cells_of(rings, n=16):
    c = np.arange(n) + 0.5
    x, y = (v.ravel() for v in np.meshgrid(c, c))
    odd = np.zeros(n * n, dtype=bool)
    for r in rings:
        for a, b in zip(r, np.roll(r, -1, axis=0), strict=True):
            if a[1] != b[1]:
                over = (a[1] > y) != (b[1] > y)
                odd ^= over & (x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]))
    return odd


def some_area(r):
    x, y, w, h = r.randrange(8), r.randrange(8), r.randrange(1, 6), r.randrange(1, 6)
    rings = [box(x, y, w, h)[:: r.choice([1, -1])]]
    if w > 2 and h > 2 and r.random() < 0.5:
        rings.append(box(x + 1, y + 1, w - 2, h - 2))
    return rings


@pytest.mark.parametrize("op", ["difference", "intersection", "union"])
def test_overlay_on_a_lattice(op):
    """Boxes with holes whose edges and corners often coincide, cell by cell; turned, scaled and moved ones by area."""
    r = random.Random(11)
    for k in range(250):
        subject, clips = some_area(r) + (some_area(r) if k % 5 == 0 else []), [some_area(r) for _ in range(r.randrange(0, 4))]
        s, c = cells_of(subject), np.zeros(256, dtype=bool)
        for x in clips:
            c |= cells_of(x)
        want = {"difference": s & ~c, "intersection": s & c, "union": s | c}[op]
        got = overlay.overlay(subject, clips, op)
        assert (cells_of([q for p in got for q in p]) == want).all() and abs(overlay.area_of(got) - want.sum()) < 1e-6
        # polygons lie apart, and each has one outer ring first
        assert sum(int(cells_of(p).sum()) for p in got) == want.sum()
        assert all(overlay.signed_area(p[0]) > 0 and all(overlay.signed_area(q) < 0 for q in p[1:]) for p in got)
        t, scale, off = r.uniform(0, 6), r.choice([1e-3, 1, 1e5]), r.uniform(-1e6, 1e6)
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) * scale
        moved = overlay.overlay([q @ turn.T + off for q in subject], [[q @ turn.T + off for q in x] for x in clips], op)
        assert abs(overlay.area_of(moved) / scale**2 - want.sum()) < 1e-3


def test_overlay_of_odd_areas():
    square = box(0, 0, 4, 4)
    assert overlay.overlay([], [[square]], "difference") == [] and overlay.overlay([square[:2]], [], "union") == []
    assert overlay.overlay([np.zeros((5, 2))], [[square]], "difference") == []
    assert [p[0].tolist() for p in overlay.overlay([square], [], "difference")] == [[[0, 0], [4, 0], [4, 4], [0, 4]]]
    assert overlay.overlay([square], [[square[::-1]]], "difference") == []
    # a hole cut out of the middle, then filled again; a cut through the whole
    ring = overlay.overlay([square], [[box(1, 1, 2, 2)]], "difference")
    assert [len(p) for p in ring] == [2] and abs(overlay.area_of(ring) - 12) < 1e-9
    assert abs(overlay.area_of(overlay.overlay(ring[0], [[box(1, 1, 2, 2)]], "union")) - 16) < 1e-9
    assert [round(overlay.area_of([p]), 9) for p in overlay.overlay([square], [[box(1, -1, 1, 9)]], "difference")] == [4, 8]
    # an island in a hole is a polygon of its own
    nested = overlay.overlay([box(0, 0, 9, 9), box(1, 1, 7, 7), box(3, 3, 2, 2)], [], "union")
    assert sorted(len(p) for p in nested) == [1, 2] and abs(overlay.area_of(nested) - (81 - 49 + 4)) < 1e-9
    # two areas that touch at a corner stay apart
    assert sorted(len(p[0]) for p in overlay.overlay([box(0, 0, 2, 2), box(2, 2, 2, 2)], [], "union")) == [4, 4]
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], dtype=float)
    assert sorted(round(overlay.area_of([p]), 9) for p in overlay.overlay([bow], [], "union")) == [1, 1]


def test_overlay_of_curves():
    a = np.linspace(0, 2 * np.pi, 700, endpoint=False)
    flower = np.stack([np.cos(a) * (1 + 0.1 * np.cos(30 * a)), np.sin(a) * (1 + 0.1 * np.cos(30 * a))], 1)
    other = flower @ np.array([[0.8, -0.6], [0.6, 0.8]]) + [0.3, 0.2]
    areas = {op: overlay.area_of(overlay.overlay([flower], [[other]], op)) for op in overlay.OPS}
    one = overlay.signed_area(flower)
    assert abs(areas["difference"] + areas["intersection"] - one) < 1e-9 and abs(areas["union"] + areas["intersection"] - 2 * one) < 1e-9


def test_subtract_many_covers(spark):
    """More covers on one area than meet in one task, in several rounds."""
    r = random.Random(3)
    parts = lambda q: [[(float(x), float(y)) for x, y in q]]
    covers = [(i, parts(box(r.randrange(16), r.randrange(16), 1, 1))) for i in range(150)] + [(1000, None), (1001, [])]
    areas = [(1, parts(box(0, 0, 16, 16))), (2, parts(box(100, 100, 3, 3))), (3, None), (4, parts(box(0, 0, 1, 16)))]
    a, c = spark.createDataFrame(areas, f"id long, parts array<{RING}>"), spark.createDataFrame(covers, f"id long, parts array<{RING}>")
    hidden = np.zeros(256, dtype=bool)
    for _, p in covers[:-2]:
        hidden |= cells_of([np.array(p[0])])
    for together in (500, 7):
        got = {x.id: x.a for x in overlay.subtract(a, c, 4.0, together).select("id", G.polygon_area(F.col("polygons")).alias("a")).collect()}
        assert {k: round(v, 6) for k, v in got.items()} == {1: 256 - hidden.sum(), 2: 9, 3: 0, 4: 16 - hidden.reshape(16, 16)[:, 0].sum()}


# --- suppression ---------------------------------------------------------------------------------------------
def greedy(nodes, pairs):
    later = {}
    for a, b in pairs:
        if a != b and None not in (a, b):
            later.setdefault(min(a, b), []).append(max(a, b))
    kept, gone = [], set()
    for n in sorted(x for x in set(nodes) if x is not None):
        if n not in gone:
            kept.append(n)
            gone.update(later.get(n, []))
    return kept


@pytest.mark.parametrize("task_edges", [5, 60, 100_000])
def test_first_wins_in_ranges(spark, task_edges):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(500)] + [(7, 7), (None, 3), (4, None)] + [(i, 299) for i in range(0, 120)] + [(0, i) for i in range(40, 80)]
    nodes = [*range(320), None]
    d, e = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(pairs, "src long, dst long")
    got = components.first_wins(d, e, task_edges=task_edges).collect()
    assert sorted(x.id for x in got) == greedy(nodes, pairs)


def test_first_wins_of_a_long_chain(spark, monkeypatch):
    """A sorted chain cut into ranges: a round for each, not one for every second node."""
    n, rounds = 30_000, []
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda d, label, **o: rounds.append(label) or real(d, label, **o))
    got = components.first_wins(spark.range(n), chain, task_edges=6000, max_rounds=30)
    assert got.agg(F.count("*"), F.max(F.col("id") % 2)).first() == (n // 2, 0)
    assert rounds.count("active") < 12


# --- GeoJSON ---------------------------------------------------------------------------------------------------
GEOMETRIES = [
    (1, "Point", [[(1.0, 2.0)]], None), (2, "MultiPoint", [[(1.0, 2.0)], [(3.0, 4.0)]], None), (3, "LineString", [[(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]], None),
    (4, "MultiLineString", [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0), (4.0, 5.0)]], None), (5, "Polygon", None, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0)]]]),
    (6, "MultiPolygon", None, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]], [[(20.0, 0.0), (29.0, 0.0), (29.0, 9.0)], [(25.0, 1.0), (26.0, 1.0), (26.0, 2.0)]]]), (7, None, None, None), (8, "LineString", [], None),
]


def test_geojson_of_every_kind(spark, tmp_path):
    kind = f"id int, kind string, parts array<{RING}>, polygons array<array<{RING}>>"
    d = spark.createDataFrame([(i, k, p if p is not None else g and [r for q in g for r in q], g) for i, k, p, g in GEOMETRIES], kind)
    sinks.write_geojson(d, f"{tmp_path}/lines", ["id"], 4326)
    said = {json.loads(r.value)["properties"]["id"]: json.loads(r.value)["geometry"] for r in spark.read.text(f"{tmp_path}/lines").collect()}
    close = lambda ring: [list(p) for p in [*ring, ring[0]]]
    assert said[1] == {"type": "Point", "coordinates": [1, 2]} and said[2] == {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}
    assert said[3] == {"type": "LineString", "coordinates": [[0, 0], [5, 5], [0, 0]]} and said[4]["coordinates"] == [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 5]]]
    assert said[5] == {"type": "Polygon", "coordinates": [close(r) for r in GEOMETRIES[4][3][0]]} and said[6]["coordinates"] == [[close(r) for r in p] for p in GEOMETRIES[5][3]]
    assert said[7] is None and said[8] is None
    back = {r.id: (r.kind, r.parts, r.polygons) for r in readers.read_features(spark, f"{tmp_path}/lines", "id:int", lines=True).collect()}
    for r in d.collect():
        if r.id < 7:
            assert back[r.id] == (r.kind, r.parts, r.polygons)
    assert spark.read.text(f"{tmp_path}/lines.crs").first().value == '{"crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::4326"},"type":"name"}}'
    bad = spark.createDataFrame([(1, "Circle", [[(1.0, 1.0)]])], f"id int, kind string, parts array<{RING}>")
    with pytest.raises(Exception, match="no GeoJSON geometry"):
        bad.select(sinks.geometry_json(F.col("kind"), F.col("parts"))).collect()


def test_feature_collection_is_one_document(spark, tmp_path):
    d = spark.createDataFrame([(i, [(0.0, 0.0), (float(i), 0.0), (1.0, 1.0)]) for i in range(50, 0, -1)], f"id long, ring {RING}").repartition(4)
    for name, rows in (("all", d), ("none", d.limit(0))):
        path = tmp_path / name
        sinks.write_feature_collection(rows, f"file://{path}", ["id"], 32632, "id")
        text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
        doc = json.loads(text)
        assert doc["type"] == "FeatureCollection" and doc["crs"]["properties"]["name"].endswith("32632")
        assert [f["properties"]["id"] for f in doc["features"]] == (list(range(1, 51)) if name == "all" else [])


def counted(monkeypatch, module, name):
    """Rows of the first table in each call of a module's function."""
    real, rows = getattr(module, name), []

    def call(df, *rest, **more):
        rows.append(df.count())
        return real(df, *rest, **more)

    monkeypatch.setattr(module, name, call)
    return rows


def squares(spark, boxes):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]
    return spark.createDataFrame([(k, [ring(*map(float, b))]) for k, b in boxes], "id long, parts array<array<struct<x:double,y:double>>>")


def test_equal_areas_are_clipped_once(spark, monkeypatch):
    rows = counted(monkeypatch, overlay, "overlay_column")
    same, other = (1, 1, 4, 3), (2, 2, 12, 4)
    found = overlay.clip_to_tiles(squares(spark, [(k, same) for k in range(50)] + [(k, other) for k in range(50, 80)]), 10.0)
    got = sorted((r.id, r.tx, r.ty, round(r.a, 6)) for r in found.select("id", "tx", "ty", G.polygon_area(F.col("polygons")).alias("a")).collect())
    assert got == [(k, 0, 0, 6.0) for k in range(50)] + [(k, x, 0, a) for k in range(50, 80) for x, a in ((0, 16.0), (1, 4.0))]
    assert rows == [3]


def test_equal_covers_are_subtracted_once(spark, monkeypatch):
    rows = counted(monkeypatch, overlay, "overlay_column")
    areas = squares(spark, [(k, (0, 0, 10, 10)) for k in range(40)] + [(k, (20, 0, 30, 10)) for k in range(40, 50)])
    covers = squares(spark, [(k, (k % 8, 0, k % 8 + 1, 5)) for k in range(400)])
    found = overlay.subtract(areas, covers, 4.0, together=3)
    got = {r.id: round(r.a, 6) for r in found.select("id", G.polygon_area(F.col("polygons")).alias("a")).collect()}
    assert got == {k: 60.0 for k in range(40)} | {k: 100.0 for k in range(40, 50)}
    # eight covers in threes, and then two areas
    assert rows == [3, 2]


def test_equal_boxes_are_suppressed_once(spark, monkeypatch):
    rng = random.Random(3)
    kinds = [(0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 4.0, 4.0), (4.0, 4.0, 5.0, 5.0), (9.0, 9.0, 9.0, 9.0), (None, 0.0, 2.0, 2.0), (3.0, 0.0, 1.0, 2.0)]
    boxes = [(k, *rng.choice(kinds)) for k in range(300)]
    meet = lambda a, b: None not in a + b and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    want = []
    for b in boxes:
        if not any(meet(a, b) for a in want):
            want.append(b)
    rows = counted(monkeypatch, vector, "box_pairs")
    got = vector.suppress(spark.createDataFrame(boxes, "id long, minx double, miny double, maxx double, maxy double"), 2.0)
    assert sorted(r.id for r in got.collect()) == [b[0] for b in want]
    assert rows == [4 + sum(b[1:] in kinds[4:] for b in boxes)]


@pytest.mark.parametrize("together", [2, 2048])
def test_pairs_of_equal_boxes_come_from_lists(spark, monkeypatch, together):
    rng = random.Random(together)
    kinds = [(0, 0, 2, 2), (1, 1, 4, 4), (4, 4, 5, 5), (9, 9, 9, 9), (None, 0, 2, 2), (3, 0, 1, 2)]
    a, b = ([(k, *rng.choice(kinds)) for k in range(n)] for n in (60, 25))
    meet = lambda a, b: None not in a + b and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    frame = lambda d: spark.createDataFrame(d, "id long, minx int, miny int, maxx int, maxy int")
    rows = counted(monkeypatch, spatial, "box_pairs")
    pairs = lambda d: sorted((r.a_id, r.b_id) for r in d.collect())
    assert pairs(spatial.meeting_boxes(frame(a), frame(b), 2.0, together=together)) == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    assert pairs(spatial.meeting_boxes(frame(b), frame(a), 2.0, together=together)) == sorted((y[0], x[0]) for x in a for y in b if meet(x, y))
    assert pairs(spatial.meeting_boxes(frame(a), frame(a), 2.0, same=True, together=together)) == sorted((x[0], y[0]) for x in a for y in a if meet(x, y) and x[0] < y[0])
    assert max(rows) == len(kinds)


def test_pairs_of_features_are_not_shuffled(spark):
    """Pairs of features are made where two lists of ids meet; only what makes them is shuffled."""
    d = squares(spark, [(k, (k % 3, 0, k % 3 + 1, 1)) for k in range(30)])
    found = vector.meeting(d, d, 4.0, True, True)
    steps = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line or "Exchange" in line]
    assert found.count() == 30 * 30 - 2 * 10 * 10 and ["Generate" in line for line in steps[:2]] == [True, True]
