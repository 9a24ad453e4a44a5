"""Road graphs: vertices, edges, dangling and isolated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators.vector import meeting
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import stage


def lines_to_graph(lines: DataFrame, convert_xy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices idx, x, y; edges src, dst) of two-point lines (line_id, x0, y0, x1, y1).

    Vertices are numbered by first appearance, coordinates cut to whole numbers, each edge listed both ways.
    """

    def xy(x: str, y: str) -> tuple[Column, Column]:
        a, b = F.col(x).cast("long"), F.col(y).cast("long")
        return (-b, a) if convert_xy else (a, b)

    (ax, ay), (bx, by) = xy("x0", "y0"), xy("x1", "y1")
    ends = lines.select(F.explode(F.array(F.struct((F.col("line_id") * 2).alias("pos"), ax.alias("x"), ay.alias("y")), F.struct((F.col("line_id") * 2 + 1).alias("pos"), bx.alias("x"), by.alias("y")))).alias("e")).select("e.*")
    vertices = prefix_sum(ends.groupBy("x", "y").agg(F.min("pos").alias("pos")), ["pos"], out="idx").select("idx", "x", "y")
    e = lines.select("line_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    s = vertices.select(F.col("idx").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    d = vertices.select(F.col("idx").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    one = e.join(s, ["ax", "ay"]).join(d, ["bx", "by"]).select("src", "dst")
    return vertices, one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph_to_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One line for every second edge row (edges are stored in both directions, in the order of ``no``)."""
    s = vertices.select(F.col("idx").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    d = vertices.select(F.col("idx").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.where("no % 2 = 0").join(s, "src").join(d, "dst").select("no", "x0", "y0", "x1", "y1")


def degrees(lines: DataFrame) -> DataFrame:
    """(x, y, degree) of the line ends."""
    ends = lines.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    return ends.groupBy("p.x", "p.y").agg(F.count("*").alias("degree"))


def meeting_lines(lines: DataFrame, cell: float = 8.0) -> DataFrame:
    """(line_id, other): every two different lines that share a point, ends, crossings and overlaps alike, both ways."""
    parts = F.array(F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1"))))
    shapes = lines.select(F.col("line_id").alias("id"), parts.alias("parts"))
    met = stage(meeting(shapes, shapes, cell, False, False, same=True), "meeting")
    return met.select(F.col("a_id").alias("line_id"), F.col("b_id").alias("other")).unionByName(met.select(F.col("b_id").alias("line_id"), F.col("a_id").alias("other")))


def line_kinds(lines: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Add kind: isolated (shares no point with another line), dangling (an end of degree 1), or inner; and the ends' degrees ``_a``, ``_b``."""
    met = meeting_lines(lines) if met is None else met
    d = degrees(lines)
    a = d.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("degree").alias("_a"))
    b = d.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("degree").alias("_b"))
    alone = met.select("line_id").distinct().withColumn("_met", F.lit(True))
    kind = F.when(F.col("_met").isNull(), "isolated").when((F.col("_a") == 1) | (F.col("_b") == 1), "dangling").otherwise("inner")
    return lines.join(a, ["x0", "y0"]).join(b, ["x1", "y1"]).join(alone, "line_id", "left").select(*[lines[c] for c in lines.columns], "_a", "_b", kind.alias("kind"))


def longest_neighbour(lines: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(line_id, neighbour): the longest other line that each dangling line shares a point with; the lower id of equals."""
    met = stage(meeting_lines(lines), "met") if met is None else met
    dangling = line_kinds(lines, met).where("kind = 'dangling'").select("line_id")
    size = F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)
    sized = lines.select(F.col("line_id").alias("other"), size.alias("size"))
    pairs = met.join(dangling, "line_id").join(sized, "other")
    return pairs.groupBy("line_id").agg(F.max_by("other", F.struct(F.col("size"), -F.col("other"))).alias("neighbour"))


def remove_dangling(lines: DataFrame, min_length: float | None, min_angle: float | None, share: float = 0.5) -> DataFrame:
    """Lines kept: inner and isolated ones, and dangling ones that are longer than a length, or turn off their longest neighbour by more than an angle.

    The angle is taken at the line's end that lies on the neighbour (the first, if both do), between its other end and the point at
    ``share`` along the neighbour, from its start; where that point is the joint, or a line only crosses its neighbour, there is no
    angle. Without a length, or an angle, that reason to keep a line falls away.
    """
    met = stage(meeting_lines(lines), "met")
    p = lambda a, b: G.point(F.col(a), F.col(b))
    other = lines.select(F.col("line_id").alias("neighbour"), *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    d = line_kinds(lines, met).where("kind = 'dangling'").join(longest_neighbour(lines, met), "line_id", "left").join(other, "neighbour", "left")
    edge = F.struct(p("nx0", "ny0").alias("a"), p("nx1", "ny1").alias("b"))
    ends = F.when(G.on_segment(edge, p("x0", "y0")), F.struct(p("x0", "y0").alias("joint"), p("x1", "y1").alias("free"))).when(G.on_segment(edge, p("x1", "y1")), F.struct(p("x1", "y1").alias("joint"), p("x0", "y0").alias("free")))
    main = G.along(p("nx0", "ny0"), p("nx1", "ny1"), share)
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    long = F.lit(False) if min_length is None else size > min_length
    turns = F.lit(False) if min_angle is None else F.coalesce(G.angle(ends["free"], ends["joint"], main) > min_angle, F.lit(False))
    return lines.join(d.where(~(long | turns)).select("line_id"), "line_id", "left_anti")
