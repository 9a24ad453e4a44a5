"""Operators without SQL against plain Python, and files of every reader and writer."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import blocks, graph, patches, raster, vector
from tilewright.plans.components import connected_components
from tilewright.sources import readers, sinks

RING = "array<struct<x:double,y:double>>"


def flood(cells, diagonal):
    """Components of a dict of (row, col) to value."""
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    seen, parts = set(), []
    for c in sorted(cells):
        if c in seen:
            continue
        seen.add(c)
        todo, part = [c], []
        while todo:
            r, k = todo.pop()
            part.append((r, k))
            for a, b in near:
                n = (r + a, k + b)
                if n in cells and n not in seen and cells[n] == cells[c]:
                    seen.add(n)
                    todo.append(n)
        parts.append(part)
    return parts


@pytest.fixture(scope="module")
def cells():
    r = random.Random(4)
    return {(i, j): r.randrange(2) for i in range(14) for j in range(14)}


@pytest.fixture(scope="module")
def pixels(spark, cells):
    return spark.createDataFrame([(0, i, j, v) for (i, j), v in cells.items()], "img long, row_no long, col_no long, lab int")


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("size", [5, 64])
def test_regions(cells, pixels, diagonal, size):
    got = blocks.region_boxes(blocks.regions(blocks.to_blocks(pixels, "lab", size), diagonal, size)).collect()
    want = [(cells[p[0]], min(c for _, c in p), min(r for r, _ in p), max(c for _, c in p) + 1, max(r for r, _ in p) + 1, len(p)) for p in flood(cells, diagonal)]
    assert sorted((r.value, r.x1, r.y1, r.x2, r.y2, r.pixels) for r in got) == sorted(want)


def test_rings(cells, pixels):
    ones = pixels.where("lab = 1")
    cut = lambda d: blocks.to_blocks(d, "lab", 5)
    found = raster.rings(blocks.outlines(cut(ones), blocks.regions(cut(ones), False, 5)), 5).collect()
    by_ring, area = defaultdict(list), defaultdict(float)
    for r in found:
        by_ring[(r.component, r.ring)].append((r.place, r.x, r.y, r.signed_area))
    for (component, _), corners in by_ring.items():
        corners.sort()
        turn = corners[1:] + corners[:1]
        assert all((a[1] == b[1]) != (a[2] == b[2]) for a, b in zip(corners, turn))
        signed = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(corners, turn)) / 2
        assert signed == corners[0][3]
        area[component] += signed
    parts = flood({k: v for k, v in cells.items() if v}, False)
    assert sorted(area.values()) == sorted(map(float, map(len, parts)))
    assert sum(1 for c in by_ring.values() if c[0][3] > 0) == len(parts)
    none = cut(ones.limit(0))
    assert raster.rings(blocks.outlines(none, blocks.regions(none))).count() == 0
    kinds = spark_categories(pixels.sparkSession)
    for f in blocks.vectorise(cut(pixels), kinds, 5).collect():
        rings = [[(p.x, p.y) for p in r] for r in f.polygon]
        area = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2 for r in rings]
        assert area[0] - sum(area[1:]) == f.pixels and (f.num, f.category) == (1, "field")


def spark_categories(spark):
    return spark.createDataFrame([(1, "field", True, None, None, None), (0, "ground", False, None, None, None)], "pixel_value int, category_name string, vectorize boolean, bbox_flag boolean, kernel_size int, min_area double")


def test_mask_boxes_keep_empty_images(spark):
    rows = [(1, 0, 0, 1), (1, 1, 1, 1), (1, 0, 3, 1), (2, 0, 0, 0)]
    d = spark.createDataFrame(rows, "img long, row_no long, col_no long, lab int")
    got = {(r.img, r.x1, r.y1, r.x2, r.y2, r.pixels) for r in blocks.mask_boxes(blocks.to_blocks(d, "lab"), 2).select("img", "x1", "y1", "x2", "y2", "pixels").collect()}
    assert got == {(1, 0, 0, 2, 2, 2), (2, None, None, None, None, None)}


def even_odd(ring, x, y):
    return sum(((ay > y) != (by > y)) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def test_fill_and_difference(spark):
    r = random.Random(8)
    shapes = [[(r.uniform(0, 20), r.uniform(0, 20)) for _ in range(n)] for n in (3, 4, 5, 7)] + [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0)], [(1.0, 1.0), (2.0, 2.0)]]
    d = spark.createDataFrame([(0, i, s) for i, s in enumerate(shapes)] + [(0, 99, None)], f"img long, id long, ring {RING}")
    inside = {(i, y, x) for i, s in enumerate(shapes) if len(s) > 2 for y in range(20) for x in range(20) if even_odd(s, x + 0.5, y + 0.5)}
    got = {(q.id, q.row_no, c) for q in raster.fill(d).collect() for c in range(q.c0, q.c1 + 1)}
    assert got == inside
    left = {(q.id, q.row_no, q.col_no) for q in raster.without(d.where("id <> 4"), d.where("id = 4")).collect()}
    assert left == {c for c in inside if c[0] != 4 and (4, c[1], c[2]) not in inside}


def test_resize(spark):
    r = random.Random(2)
    h, w, n = 9, 7, 3
    data = bytes(r.randrange(256) for _ in range(h * w * n))
    images = spark.createDataFrame([("a", h, w, n, 16, data), ("b", -1, -1, -1, -1, b"")], "origin string, height int, width int, nChannels int, mode int, data binary")
    got = raster.resize_images(images, 4, 5).collect()
    assert [(g.origin, g.height, g.width) for g in got] == [("a", 4, 5)]
    table = spark.createDataFrame([(0, i, j, data[(i * w + j) * n]) for i in range(h) for j in range(w)], "img long, row_no long, col_no long, v int")
    sizes = spark.createDataFrame([(0, h, w)], "img long, h long, w long")
    for p in raster.resize(table, sizes, "v", 4, 5).collect():
        assert abs(got[0].data[(p.row_no * 5 + p.col_no) * n] - p.v) <= 0.5 + 1e-9


def test_entry_points(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    roads = {
        1: [(-5.0, 5.0), (15.0, 5.0)], 2: [(5.0, 5.0), (15.0, 5.0)], 3: [(2.0, 2.0), (8.0, 8.0)], 4: [(-5.0, 20.0), (20.0, 20.0)],
        5: [(-5.0, 2.0), (5.0, 2.0), (5.0, 15.0), (8.0, 15.0), (8.0, 5.0)], 6: [(0.0, 5.0), (-5.0, 5.0)],
    }
    a = spark.createDataFrame(list(roads.items()), f"id long, line {RING}")
    b = spark.createDataFrame([(7, square)], f"id long, ring {RING}").withColumn("minx", F.lit("clash"))
    cut = {(r.road, r.x, r.y) for r in vector.crossing_points(a, b, 4.0).collect()}
    assert cut == {(1, 0, 5), (1, 10, 5), (2, 10, 5), (5, 0, 2), (5, 5, 10), (5, 8, 10), (6, 0, 5)}
    got = {(r.road, r.x, r.y) for r in vector.entry_points(a, b, 4.0).collect()}
    assert got == {(1, 0, 5), (1, 10, 5), (2, 10, 5), (5, 0, 2), (6, 0, 5)}
    assert vector.entry_points(a.limit(0), b, 4.0).count() == 0


def test_spatial_join_over_levels(spark):
    r = random.Random(9)
    some = lambda n: [(i, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + r.choice([0, 1, 7, 70, 900, 9000]), y + r.choice([0, 2, 30, 2000])) for i in range(n)] + [(n, None, 0.0, 1.0, 1.0)]
    a, b = some(60), some(70)
    want = sorted((p[0], q[0]) for p in a[:-1] for q in b[:-1] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    kind = "id long, minx double, miny double, maxx double, maxy double"
    got = G.spatial_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 2.0)
    assert sorted((p.a_id, p.b_id) for p in got.collect()) == want


def test_suppression_and_components(spark):
    r = random.Random(6)
    boxes = [(i, x := r.randrange(60), y := r.randrange(60), x + r.randrange(1, 9), y + r.randrange(1, 9)) for i in range(80)]
    kept = []
    for b in boxes:
        if not any(b[1] <= k[3] and k[1] <= b[3] and b[2] <= k[4] and k[2] <= b[4] for k in kept):
            kept.append(b)
    d = spark.createDataFrame(boxes, "id long, minx long, miny long, maxx long, maxy long")
    assert sorted(q.id for q in vector.suppress(d, 4.0).collect()) == [k[0] for k in kept]
    pairs = [(i, i + 1) for i in range(200) if i % 50 != 49]
    parts = connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {q.node: q.component for q in parts} == {i: i // 50 * 50 for i in range(200)}


def test_remove_dangling(spark):
    # a main road 1-2 with a short spur at a right angle, a long spur, and one that nearly goes on; 9 stands alone
    rows = [(1, 0, 0, 10, 0), (2, 10, 0, 20, 0), (3, 10, 0, 10, 1), (4, 10, 0, 10, 9), (5, 20, 0, 22, 0), (9, 50, 50, 51, 50)]
    d = spark.createDataFrame(rows, "line_id long, x0 long, y0 long, x1 long, y1 long")
    kinds = {r.line_id: r.kind for r in graph.line_kinds(d).collect()}
    assert kinds == {1: "dangling", 2: "inner", 3: "dangling", 4: "dangling", 5: "dangling", 9: "isolated"}
    ids = lambda *a: sorted(r.line_id for r in graph.remove_dangling(d, *a).collect())
    assert ids(5.0, 120.0) == [1, 2, 4, 5, 9]
    assert ids(5.0, 80.0) == [1, 2, 3, 4, 5, 9]
    assert ids(5.0, None) == [1, 2, 4, 9]
    assert ids(None, None) == [2, 9]


def test_hull_and_rings(spark):
    d = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 2.0)]), (2, None), (3, [(1.0, 1.0)])], f"id long, points {RING}")
    got = {r.id: r.h and [(p.x, p.y) for p in r.h] for r in d.select("id", G.convex_hull().alias("h")).collect()}
    assert sorted(got[1]) == [(0, 0), (0, 2), (2, 0), (2, 2)] and got[2] is None and got[3] == [(1, 1)]
    bow = spark.createDataFrame([([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)],), ([(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)],), (None,)], f"r {RING}")
    assert [r.ok for r in bow.select(G.valid_ring(F.col("r")).alias("ok")).collect()] == [False, True, False]


def test_utm(spark):
    got = spark.range(1).select(*[G.utm(F.lit(x), F.lit(y), 32).alias(n) for n, x, y in (("o", 9.0, 0.0), ("edge", 12.0, 0.0), ("mid", 9.0, 45.0))]).first()
    assert abs(got.o.x - 500000) < 1e-6 and abs(got.o.y) < 1e-6
    # fixed values: the easting of a zone's edge at the equator; 0.9996 times the WGS84 meridian arc to 45 degrees
    assert abs(got.edge.x - 833978.5569) < 1e-3 and abs(got.edge.y) < 1e-6
    assert abs(got.mid.x - 500000) < 1e-6 and abs(got.mid.y - 0.9996 * 4984944.3780) < 1e-3


def test_intersects(spark):
    square, hole = [(0, 0), (0, 9), (9, 9), (9, 0)], [(2, 2), (2, 7), (7, 7), (7, 2)]
    cases = [
        ([square, hole], [[(3, 3), (4, 4)]], False), ([square, hole], [[(3, 3), (8, 8)]], True), ([square], [[(3, 3), (4, 4)]], True), ([square], [[(9, 9), (12, 9)]], True),
        ([square], [[(9, 3), (9, 20)]], True), ([square], [[(10, 3), (12, 20)]], False), ([square], [[(5, 5)]], True), ([square, hole], [[(5, 5)]], False), (None, [[(5, 5)]], False), ([square], [], False),
    ]
    parts = lambda g: None if g is None else [[(float(x), float(y)) for x, y in p] for p in g]
    d = spark.createDataFrame([(i, parts(a), parts(b)) for i, (a, b, _) in enumerate(cases)], f"i int, a array<{RING}>, b array<{RING}>")
    got = {r.i: r.x for r in d.select("i", G.intersects(F.col("a"), F.col("b"), True, False).alias("x")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    seg = spark.createDataFrame([((0.0, 0.0), (4.0, 0.0), (2.0, 0.0), (9.0, 0.0)), ((0.0, 0.0), (4.0, 0.0), (5.0, 0.0), (9.0, 0.0))], "a struct<x:double,y:double>, b struct<x:double,y:double>, c struct<x:double,y:double>, d struct<x:double,y:double>")
    met = seg.select(G.meeting_points(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("d").alias("b"))).alias("p")).collect()
    assert [sorted((p.x, p.y) for p in r.p) for r in met] == [[(2, 0), (4, 0)], []]


def test_crossing_lines_are_not_isolated(spark):
    d = spark.createDataFrame([(1, 0, 5, 10, 5), (2, 5, 0, 5, 9), (3, 50, 50, 60, 60)], "line_id long, x0 long, y0 long, x1 long, y1 long")
    assert {r.line_id: r.kind for r in graph.line_kinds(d).collect()} == {1: "dangling", 2: "dangling", 3: "isolated"}
    assert sorted((r.line_id, r.neighbour) for r in graph.longest_neighbour(d).collect()) == [(1, 2), (2, 1)]


def test_combine_finds_mixed_systems(spark):
    d = spark.createDataFrame([(1, [[(0.0, 0.0)]], 32632)], f"id long, parts array<{RING}>, epsg int")
    assert vector.combine([d, d]).select("id").count() == 2
    with pytest.raises(ValueError, match="mixed coordinate systems"):
        vector.combine([d, d.withColumn("epsg", F.lit(4326))]).select("id")


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    notes = put("a/x.json", json.dumps({"img_name": "i.jpg", "bboxes": [{"category": "tank", "x1": 1, "x2": 3, "y1": 2, "y2": 4}, {"category": "", "x1": "", "x2": "", "y1": "", "y2": ""}]}))
    assert [tuple(r) for r in readers.read_annotations(spark, notes).collect()] == [("i.jpg", "tank", 1, 2, 3, 4), ("i.jpg", "", None, None, None, None)]
    tasks = put("t.json", json.dumps({"tasks": [{"name": "n", "Tags": {"tags": [{"tags": {"tag": "Roof", "points": [[0, 0], [4, 0], [4, 5.5]]}}, {"tags": {"tag": "Other", "points": [[0, 0]]}}]}}]}))
    found = vector.task_boxes(readers.read_tasks(spark, tasks), {"Roof": 1}).collect()
    assert [tuple(r) for r in found] == [("n", 1, 0, 0, 4, 5)]
    shapes = put("f.geojson", json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
        {"type": "Feature", "properties": {"k": 2}, "geometry": None},
        {"type": "Feature", "properties": {"k": 3}, "geometry": {"type": "Point", "coordinates": [5, 6]}},
        {"type": "Feature", "properties": {"k": 4}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [0, 9], [9, 9], [9, 0], [0, 0]], [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]], [[[20, 0], [20, 2], [22, 2], [20, 0]]]]}},
    ]}))
    read = readers.read_features(spark, shapes, "k:int")
    area = {r.k: r.a for r in read.select("k", G.polygon_area(F.col("polygons")).alias("a")).collect()}
    assert area == {1: None, 2: None, 3: None, 4: 79.0}
    got = {r.k: r.parts for r in read.collect()}
    assert [len(p) for p in got[4]] == [4, 4, 3]
    assert len(got[1]) == 2 and got[2] is None and (got[3][0][0].x, got[3][0][0].y) == (5, 6)
    table = put("c.csv", "pixel_value , category_name\n 1 , road \n2,house\n")
    assert [(r.pixel_value, r.category_name, r.vectorize, r.min_area) for r in readers.read_categories(spark, table).collect()] == [(1, "road", True, None), (2, "house", True, None)]
    v, e = readers.read_graph(spark, put("g.graph", "0 0\n5 5\n9 1\n\n0 1\n1 0\n1 2\n2 1\n"))
    lines = graph.graph_to_lines(v, e).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in lines) == [(0, 0, 5, 5), (5, 5, 9, 1)]
    assert [(r.stem, r.length) for r in readers.list_files(spark, str(tmp_path), ".csv").collect()] == [("c", len("pixel_value , category_name\n 1 , road \n2,house\n"))]
    assert [r.name for r in readers.read_urls(spark, put("u.txt", "http://h/a.jpg\nhttp://h/b.jpg \n")).collect()] == ["a.jpg", "b.jpg"]


def test_writers_read_back(spark, tmp_path):
    ring = G.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(3))
    d = spark.createDataFrame([(1, "road"), (2, None)], "id long, name string").withColumn("ring", F.when(F.col("id") == 1, ring))
    sinks.write_geojson(d, f"{tmp_path}/f", ["name", "id"], 32632)
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/f").collect()), key=lambda f: f["properties"]["id"])
    assert got[0]["geometry"]["coordinates"][0][0] == got[0]["geometry"]["coordinates"][0][-1] == [0.0, 0.0]
    assert got[1]["geometry"] is None and got[1]["properties"] == {"id": 2, "name": None} and list(got[0]) == ["geometry", "properties", "type"]
    assert "EPSG::32632" in spark.read.text(f"{tmp_path}/f.crs").first().value
    boxes = spark.createDataFrame([("i.jpg", 1, 2, 3, 4, "a,b"), ("j.jpg", None, None, None, None, None)], "img_name string, x1 int, y1 int, x2 int, y2 int, category string")
    sinks.write_boxes(boxes, "data", f"{tmp_path}/b")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/b").collect()) == ["data/i.jpg,1,2,3,4,|a,b|", "data/j.jpg,,,,,"]
    m = spark.createDataFrame([("training", 0, "a"), ("validation", 0, "b")], "split string, pos long, image string")
    sinks.write_manifest(m, f"{tmp_path}/m")
    assert {(r.split, r.image) for r in spark.read.json(f"{tmp_path}/m").collect()} == {("training", "a"), ("validation", "b")}
    sinks.write_lines(m, "image", f"{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == ["a", "b"]


def test_patch_names_from_a_million_on(spark):
    """The query's SQL cuts names to six digits; the operator does so only when asked."""
    rows = spark.range(1_000_002)
    last = lambda **k: [r.patch for r in patches.patch_names(rows, ["id"], **k).where("id >= 999999").orderBy("id").collect()]
    assert last() == ["patch_999999.jpg", "patch_1000000.jpg", "patch_1000001.jpg"]
    assert last(parity=True) == ["patch_999999.jpg", "patch_100000.jpg", "patch_100000.jpg"]


def test_resizing_broadcasts_no_pixels(spark):
    """What the few sizes grow to is shuffled, however small they are."""
    pixels = spark.range(4 * 36).selectExpr("id div 36 as img", "id % 36 div 6 as row_no", "id % 6 as col_no", "id % 7 as v")
    sizes = pixels.select("img").distinct().withColumns({"h": F.lit(6), "w": F.lit(6)})
    found = raster.resize(pixels, sizes, "v", 3, 3)
    want = defaultdict(float)
    for p in pixels.collect():
        want[p.img, p.row_no // 2, p.col_no // 2] += p.v / 4
    assert {(r.img, r.row_no, r.col_no): r.v for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
