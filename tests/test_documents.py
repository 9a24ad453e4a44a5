"""Large single documents read by many tasks, and sinks that commit as a whole."""

import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import committed, documents, images, readers, sinks

RING = "array<struct<x:double,y:double>>"


# --- GeoJSON by byte ranges -----------------------------------------------------------------------------------
def feature(i, r):
    name = "".join(r.choices(['"', "\\", "{", "}", "[", "]", "a", "é", "\n", "日", ":", ","], k=r.randrange(0, 30)))
    kind, c = r.choice([("Point", [i, 1]), ("LineString", [[0, 0], [i, 2]]), ("Polygon", [[[0, 0], [1, i], [5, 5], [0, 0]]])])
    return {"type": "Feature", "properties": {"id": i, "name": name, "nested": {"a": [{"b": name}]}}, "geometry": {"type": kind, "coordinates": c}}


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_collections_by_byte_ranges(spark, tmp_path, chunk):
    """Texts full of quotes, backslashes and brackets, cut anywhere."""
    r = random.Random(chunk)
    n = 12 if chunk == 7 else 60
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}
    for k, (indent, ascii_) in enumerate([(None, True), (1, False)]):
        features = [feature(1000 * k + i, r) for i in range(n)]
        doc = {"name": 'odd " \\ { [ name', "crs": {"properties": {"name": "x"}}, "features": features, "links": [{"type": "Link", "features": [1]}], "bbox": [[1, 2], [3, 4]]}
        (folder / f"d{k}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_))
        want |= {f["properties"]["id"]: (f["properties"]["name"], f["geometry"]["type"]) for f in features}
    found, rejects = documents.read_feature_collections(spark, f"file://{folder}", "id:bigint,name:string", chunk=chunk)
    got = found.collect()
    assert len(got) == len(want) and {x.id: (x.name, x.kind) for x in got} == want
    assert rejects.count() == 0
    plain = readers.read_features(spark, f"file://{folder}/d0.geojson", "id:bigint,name:string").select("id", "kind", "parts").collect()
    assert sorted(map(str, plain)) == sorted(map(str, found.where("id < 1000").select("id", "kind", "parts").collect()))


def test_broken_features_are_rejects(spark, tmp_path):
    text = '{"features": [{"type": "Feature", "properties": {"id": 1}, "geometry": null}, {"type": "Feature", "properties": {"id": oops}}, {"type": "Feature", "properties": {"id": 3}, "geometry": null}, {"type": "Feature", "properties": {"id": 4'
    (tmp_path / "a.geojson").write_text(text)
    (tmp_path / "empty.geojson").write_text("")
    for chunk in (16, 1 << 20):
        found, rejects = documents.read_feature_collections(spark, f"file://{tmp_path}", "id:bigint", chunk=chunk)
        assert sorted(r.id for r in found.collect()) == [1, 3]
        bad = sorted((r.start, r.value) for r in rejects.collect())
        assert [v for _, v in bad] == ['{"type": "Feature", "properties": {"id": oops}}', '{"type": "Feature", "properties": {"id": 4'] and all(text[s:].startswith(v) for s, v in bad)


def test_states_of_a_reader():
    r = random.Random(3)
    for _ in range(300):
        data = "".join(r.choices(['"', "\\", "{", "}", "[", "]", "x"], k=40)).encode()
        escaped, inside = r.random() < 0.5, r.random() < 0.5
        quotes, down, up = documents.scan_json(data, escaped)
        state, skip, level = inside, escaped, 0
        for c in data.decode():
            if skip:
                # behind a backslash only a quote is another thing; brackets in strings never count
                skip = c == "\\" and False
                if c != "\\":
                    if not state and c in "{[":
                        level += 1
                    elif not state and c in "}]":
                        level -= 1
                continue
            if c == "\\":
                skip = True
            elif c == '"':
                state = not state
            elif not state and c in "{[}]":
                level += 1 if c in "{[" else -1
        assert (inside ^ (len(quotes) % 2 == 1)) == state
        assert len(documents._outside(down, quotes, inside)) - len(documents._outside(up, quotes, inside)) == level


# --- manifests ---------------------------------------------------------------------------------------------------
MANIFEST = """# a data set
name: "set \\"one\\""
prefix: /data # where it lies
ground_truth:
  type: mask
  classes:
    - index: 0
      name: background
    - index: 1
      name: road
training:
  images:
  - a.png
  - "b \\\\ c.png"   # quoted
  # not an item

  - 'it''s.png'
  labels:
  - a.tif
  - null
  probability:
    - 0.25
    - much
    - 1e-3
validation:
  images: [x.png, y.png]
  labels: []
testing:
  images:
    - last.png
  oops
"""


def test_manifest_by_lines(spark, tmp_path):
    (tmp_path / "m.yml").write_text(MANIFEST)
    rows, rejects = documents.read_large_manifests(spark, f"file://{tmp_path}/m.yml")
    got = sorted((r.split, r.pos, r.image, r.label, r.probability) for r in rows.collect())
    assert got == [("testing", 0, "last.png", None, None), ("training", 0, "a.png", "a.tif", 0.25), ("training", 1, "b \\ c.png", None, None), ("training", 2, "it's.png", None, 0.001)]
    assert {(r.dataset, r.prefix) for r in rows.collect()} == {('set "one"', "/data")}
    lines = MANIFEST.split("\n")
    bad = {(r.line, r.problem) for r in rejects.collect()}
    assert bad == {(lines.index("    - much"), "no number"), (lines.index("  images: [x.png, y.png]"), "a list that is not in lines of its own"), (lines.index("  oops"), "no key, item or comment")}
    assert all(lines[r.line] == r.value for r in rejects.collect())


def test_manifest_of_many_blocks(spark, tmp_path):
    """One document cut into blocks that different tasks read, beside others; equal to the reader of whole documents."""
    for k in range(2):
        items = [f"p{k}_{i}.png" for i in range(3000)]
        doc = [f"name: set{k}", "prefix: /x", "training:", "  images:", *[f"    - {json.dumps(x)}" for x in items], "  labels:", *[f"    - {x[:-4]}.tif" for x in items], "validation:", "  images:", "    - v.png"]
        (tmp_path / f"m{k}.yml").write_text("\n".join(doc) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, rejects = documents.read_large_manifests(spark, f"file://{tmp_path}")
        cols = ["dataset", "prefix", "split", "pos", "image", "label", "probability"]
        got = sorted(map(str, rows.select(*cols).collect()))
        assert committed.text_lines(spark, f"file://{tmp_path}").select(F.spark_partition_id()).distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(map(str, readers.read_manifest(spark, f"file://{tmp_path}").select(*cols).collect())) and len(got) == 6002
    assert rejects.count() == 0


# --- commits -------------------------------------------------------------------------------------------------------
def test_committed_document(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    d = spark.range(5000, 0, -1).select("id", F.format_string("line %d", "id").alias("value")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        committed.write_ordered_lines(d, path, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = "".join(open(p.removeprefix("file://")).read() for p in committed.committed_parts(path))
    assert text == "".join(f"line {i}\n" for i in range(1, 5001)) and len(committed.committed_parts(path)) > 1
    got = committed.text_lines(spark, path)
    assert [r.value for r in got.orderBy("part", "block", "place").collect()] == text.split("\n")[:-1] and got.select("document").distinct().count() == 1
    with pytest.raises(Exception, match="written already"):
        committed.write_ordered_lines(d, path, ["id"])
    assert len(os.listdir(tmp_path / "doc")) == 2
    committed.write_ordered_lines(d.where("id <= 3"), path, ["id"], overwrite=True)
    assert [r.value for r in committed.text_lines(spark, path).orderBy("part", "block", "place").collect()] == ["line 1", "line 2", "line 3"]
    assert len([f for f in os.listdir(tmp_path / "doc") if f.startswith("job-")]) == 1
    committed.write_ordered_lines(d.limit(0), f"{path}0", ["id"])
    assert committed.text_lines(spark, f"{path}0").count() == 0 and committed.committed_parts(f"{path}0") == []
    with pytest.raises(FileNotFoundError):
        committed.committed_parts(f"{path}1")


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    d = spark.range(4000).select("id", F.when(F.col("id") == 3900, F.raise_error(F.lit("a broken row"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken row"):
        committed.write_ordered_lines(d, path, ["id"])
    with pytest.raises(FileNotFoundError):
        committed.committed_parts(path)
    left = [f for _, _, names in os.walk(tmp_path / "doc") for f in names] if (tmp_path / "doc").exists() else []
    assert left == []


def test_committed_images(spark, tmp_path):
    path = f"file://{tmp_path}/images"
    pixels = np.arange(48, dtype=np.uint8).tobytes()
    d = spark.createDataFrame([(f"t{i}", 4, 4, 3, pixels) for i in range(20)], "name string, height int, width int, nChannels int, data binary").repartition(3)
    sinks.write_committed_images(d, path)
    found = readers.read_images(spark, committed.committed_parts(path))
    assert found.count() == 20 and {bytes(r.data) for r in found.collect()} == {pixels}


def test_graph_and_manifest_documents(spark, tmp_path):
    v = spark.createDataFrame([(i, i * 10, -i) for i in range(40)], "idx long, x long, y long")
    e = spark.createDataFrame([(i, i % 40, (i * 7) % 40) for i in range(60)], "no long, src long, dst long")
    path = f"file://{tmp_path}/g"
    sinks.write_graph(v.repartition(3), e.repartition(5), path)
    vertices, edges = readers.read_graph(spark, path)
    assert sorted((r.idx, r.x, r.y) for r in vertices.collect()) == sorted(tuple(r) for r in v.collect())
    assert sorted((r.no, r.src, r.dst) for r in edges.collect()) == sorted(tuple(r) for r in e.collect())
    m = spark.createDataFrame([("training", i, f'im "{i}".png', None if i % 3 else f"m{i}.tif", i / 4) for i in range(30)] + [("testing", 0, "t.png", None, None)], "split string, pos long, image string, label string, probability double")
    sinks.write_manifest_document(m, f"file://{tmp_path}/m", "a: set", "/p # x")
    rows, rejects = documents.read_large_manifests(spark, f"file://{tmp_path}/m")
    assert sorted(map(str, rows.select(*m.columns).collect())) == sorted(map(str, m.collect())) and rejects.count() == 0
    assert {(r.dataset, r.prefix) for r in rows.collect()} == {("a: set", "/p # x")}


# --- GeoTIFF -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("dtype", "bands", "tile", "deflate"), [("u1", 1, None, True), ("u2", 3, 16, True), ("i2", 2, 32, False), ("f4", 1, None, False), ("i4", 1, 16, True)])
def test_geotiff_in_blocks(spark, tmp_path, dtype, bands, tile, deflate):
    from tilewright.operators import stacks
    from tilewright.sources import geotiff

    a = np.random.default_rng(1).integers(0, 120, (75, 50, bands)).astype(dtype)
    where = (2.0, 0.5, 1000.0, -0.25, -2.0, 5000.0)
    (tmp_path / "one.tif").write_bytes(geotiff.encode(a, where, 32633, tile=tile, rows=9, deflate=deflate, nodata=7))
    (tmp_path / "two.tif").write_bytes(geotiff.encode(a[:5, :3], tile=tile))
    (tmp_path / "bad.tif").write_bytes(b"no raster")
    (tmp_path / "cut.tif").write_bytes(geotiff.encode(a, where)[:60])
    found, known, rejects = geotiff.read_geotiff(spark, f"file://{tmp_path}", 20)
    got = {r.stem: r for r in known.collect()}
    assert sorted(got) == ["one", "two"] and (got["one"].height, got["one"].width, got["one"].bands, got["one"].dtype, got["one"].epsg, got["one"].nodata) == (75, 50, bands, dtype, 32633, 7)
    assert tuple(got["one"][c] for c in "abcdef") == where and got["two"].a is None and got["two"].epsg is None
    assert {r.path.split("/")[-1] for r in rejects.collect()} == {"bad.tif", "cut.tif"}
    out = np.full(a.shape, np.nan)
    for r in found.where(F.col("img") == got["one"].img).collect():
        assert r.h <= 20 and r.w <= 20
        out[r.row0 : r.row0 + r.h, r.col0 : r.col0 + r.w] = np.frombuffer(r.data, np.float32).reshape(r.h, r.w, r.channels)
    assert np.array_equal(out, np.where(a == 7, np.nan, a.astype(float)), equal_nan=True)
    from tilewright.operators import blocks

    ones = {(r.row_no, r.col_no): r.v for r in blocks.to_pixels(stacks.one_band(found, bands - 1)).where(F.col("img") == got["two"].img).collect()}
    assert ones == {(y, x): int(a[y, x, bands - 1]) for y in range(5) for x in range(3)}


def test_geotiff_of_other_layouts():
    """Big-endian and big TIFF, planes one after another, differences along rows, scale and tie point, pixel centres."""
    import struct
    import zlib

    from tilewright.sources import geotiff

    a = np.random.default_rng(2).integers(0, 255, (6, 5, 2)).astype("u1")
    for order, big in (("<", False), (">", False), ("<", True), (">", True)):
        word, number = ("Q", "Q") if big else ("I", "H")
        diff = np.diff(a.astype(np.int16), axis=1, prepend=0).astype("u1")
        parts = [zlib.compress(diff[y : y + 4, :, k].tobytes()) for k in (0, 1) for y in (0, 4)]
        head = 16 if big else 8
        at = [head]
        for p in parts:
            at.append(at[-1] + len(p))
        doubles = at[-1]
        body = b"".join(parts) + struct.pack(f"{order}9d", 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 100.0, 200.0, 0.0)
        lists = len(body) + head
        body += struct.pack(f"{order}4{word}", *at[:4]) + struct.pack(f"{order}4{word}", *map(len, parts)) + struct.pack(f"{order}12H", 1, 1, 0, 2, 1025, 0, 1, 2, 2048, 0, 1, 4326)
        wide = struct.calcsize(word)
        kind = 16 if big else 4
        entries = [(256, 3, 1, 5), (257, 3, 1, 6), (258, 3, 2, None), (259, 3, 1, 8), (273, kind, 4, lists), (277, 3, 1, 2), (278, 3, 1, 4), (279, kind, 4, lists + 4 * wide), (284, 3, 1, 2), (317, 3, 1, 2), (33550, 12, 3, doubles), (33922, 12, 6, doubles + 24), (34735, 3, 12, lists + 8 * wide)]
        ifd = struct.pack(f"{order}{number}", len(entries))
        for tag, k, n, v in entries:
            value = struct.pack(f"{order}2H", 8, 8) if v is None else struct.pack(f"{order}H", v) if k == 3 and n == 1 else struct.pack(f"{order}{word}", v)
            ifd += struct.pack(f"{order}HH{word}", tag, k, n) + value.ljust(wide, b"\0")
        start = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, head + len(body)) if big else struct.pack(f"{order}HI", 42, head + len(body)))
        data = start + body + ifd + b"\0" * 8
        read = lambda place, size, d=data: d[place : place + size]
        tags = geotiff.header(read)
        p = geotiff.profile(tags)
        assert (p["height"], p["width"], p["bands"], p["epsg"], p["transform"]) == (6, 5, 2, 4326, (2.0, 0.0, 99.0, 0.0, -3.0, 201.5))
        assert (geotiff.read_area(read, tags, p, 1, 2, 5, 3) == a[1:, 2:]).all()


def test_small_ranges_share_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"d{k}.geojson").write_text(json.dumps({"features": [{"type": "Feature", "properties": {"id": 10 * k + i}, "geometry": None} for i in range(10)]}))
    ranges = documents.byte_ranges(spark, f"file://{tmp_path}", 64)
    assert ranges.count() > 300 and documents._dealt(ranges).rdd.getNumPartitions() == 1
    found, rejects = documents.read_feature_collections(spark, f"file://{tmp_path}", "id:bigint", chunk=64)
    assert sorted(r.id for r in found.collect()) == list(range(300)) and rejects.count() == 0


def test_objects_of_tasks_do_not_carry_their_document(spark, tmp_path):
    tags = [{"tags": {"tag": "Roof", "points": [[i, 1], [i, 2], [3, 4]]}} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps({"tasks": [{"name": f"n{k}", "Tags": {"tags": tags}} for k in range(2)]}))
    found = readers.read_tasks(spark, f"file://{tmp_path}")
    assert sorted((r.name, r.tag, r.points[0].x) for r in found.collect()) == sorted((f"n{k}", "Roof", float(i)) for k in range(2) for i in range(200))
    # what a row is given of the row it comes from: a name and the array, not the task
    plan = found._jdf.queryExecution().optimizedPlan()
    while "Generate" not in plan.nodeName():
        plan = plan.children().apply(0)
    kinds = [plan.child().output().apply(k).dataType().simpleString() for k in range(plan.child().output().size())]
    assert sorted(k[:5] for k in kinds) == ["array", "strin"]


def filtered_png(a, kind):
    """A PNG file of an array [h, w, n] (red first) whose lines all have one filter, with chunks before its pixels."""
    h, w, n = a.shape
    left, above = np.zeros_like(a), np.zeros_like(a)
    left[:, 1:], above[1:] = a[:, :-1], a[:-1]
    corner = np.zeros_like(a)
    corner[1:, 1:] = a[:-1, :-1]
    x, y, z = (v.astype(int) for v in (left, above, corner))
    near = np.stack([abs(y - z), abs(x - z), abs(x + y - 2 * z)])
    guess = [0 * x, x, y, (x + y) // 2, np.choose(near.argmin(axis=0), [x, y, z])][kind]
    lines = np.concatenate([np.full((h, 1), kind, np.uint8), ((a - guess) & 255).astype(np.uint8).reshape(h, w * n)], axis=1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    body = zlib.compress(lines.tobytes())
    return images.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + part(b"tEXt", b"a\0b") + part(b"IDAT", body[:20]) + part(b"IDAT", body[20:]) + part(b"IEND", b"")


def test_images_are_read_as_by_the_image_source(spark, tmp_path):
    """Every filter, grey and colour, broken files, hidden ones, odd names; a bitmap, which only the image source reads."""
    r = np.random.default_rng(5)
    for k in range(5):
        for n in (1, 3):
            a = r.integers(0, 256, (7, 5, n)).astype(np.uint8) if k % 2 else (np.arange(35 * n) * 3 % 256).astype(np.uint8).reshape(7, 5, n)
            (tmp_path / f"f {k}#{n}%é.png").write_bytes(filtered_png(a, k))
    (tmp_path / "none.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / ".hidden.png").write_bytes(b"no image")
    (tmp_path / "below").mkdir()
    rows = lambda d: sorted((x.origin, x.height, x.width, x.nChannels, x.mode, bytes(x.data)) for x in d.collect())
    path = f"file://{tmp_path}"
    plain = images.images_of(spark, [path])
    assert rows(plain) == rows(images.source_images(spark, [path])) and len(rows(plain)) == 11
    # nothing is left to the image source, and so to the driver's list of files
    assert all("binary" not in f and not f.endswith(".png") for f in plain.inputFiles())
    (tmp_path / "b.png").write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\x01\x02\x03\0")
    assert rows(readers.read_images(spark, path)) == rows(images.source_images(spark, [path])) and len(rows(images.images_of(spark, [path]))) == 12


def test_a_cut_png_is_broken(spark, tmp_path):
    whole = filtered_png(np.zeros((4, 4, 3), np.uint8), 0)
    (tmp_path / "a.png").write_bytes(whole)
    (tmp_path / "b.png").write_bytes(whole[:-20])
    (tmp_path / "c.png").write_bytes(whole[:60] + bytes([whole[60] ^ 1]) + whole[61:])
    got = {r.origin[-5:]: r.height for r in readers.read_images(spark, f"file://{tmp_path}").collect()}
    assert got["a.png"] == 4 and got["c.png"] == -1
    assert {r.origin[-5:] for r in readers.bad_images(spark, f"file://{tmp_path}").collect()} == {p for p, h in got.items() if h == -1}


def test_world_files_are_listed_by_tasks(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"t{k}.pgw").write_text(f"0.5\n0\n0\n-0.5\n{k + 0.25}\n{9 - k}\n")
    found = readers.read_world_files(spark, f"file://{tmp_path}")
    assert sorted((r.stem, r.c) for r in found.collect()) == [(f"t{k}", float(k)) for k in range(5)]
    assert not any(f.endswith(".pgw") for f in found.inputFiles())
