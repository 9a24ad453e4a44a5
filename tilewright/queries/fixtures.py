"""Inputs of the operators' shapes, as SQL that Spark and DuckDB both run over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "part", "embeddings")
SQL = {
    "label_pixels": """SELECT l_orderkey % 40 AS img_id, CAST(l_linenumber % 7 AS BIGINT) AS actual,
        CAST(CASE WHEN l_quantity > 10 THEN l_linenumber % 7 ELSE l_suppkey % 9 END AS BIGINT) AS predicted FROM {lineitem}""",
    "boxes": """SELECT o_orderkey AS box_id, concat('img_', CAST(o_custkey % 50 AS VARCHAR(12))) AS img_name, o_orderpriority AS category,
        o_orderkey * 37 % 460 AS x1, o_orderkey * 53 % 460 AS y1, o_orderkey * 37 % 460 + o_orderkey * 17 % 60 - 2 AS x2,
        o_orderkey * 53 % 460 + o_orderkey * 29 % 60 - 2 AS y2 FROM {orders}""",
    "mask_stats": """SELECT o_orderkey AS pos, concat('p', CAST(o_orderkey AS VARCHAR(12))) AS filename,
        CASE WHEN o_orderkey % 150 = 0 THEN 'poc' ELSE 'rest' END AS source,
        CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 7919 % 100000 END AS roads,
        1000000 - CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 7919 % 100000 END AS background FROM {orders}""",
    "patch_loss": "SELECT concat('p', CAST(o_orderkey AS VARCHAR(12)), '.jpg') AS patch_name, o_totalprice AS loss FROM {orders}",
    "url_list": """SELECT o_orderkey AS pos, concat('http://h/', CAST(o_orderkey % 3 AS VARCHAR(12)), '/p', CAST(o_orderkey % 900 AS VARCHAR(12)), '.jpg') AS url
        FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "manifest": """SELECT o_orderkey AS pos, concat('images/p', CAST(o_orderkey AS VARCHAR(12)), '.png') AS image,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('masks/p', CAST(o_orderkey AS VARCHAR(12)), '.tif') END AS label FROM {orders}""",
    "pixels": """SELECT CAST(floor(o_orderkey / 2500) AS BIGINT) AS img, CAST(floor(o_orderkey % 2500 / 50) AS BIGINT) AS row_no,
        o_orderkey % 50 AS col_no, o_orderkey * 31 % 256 AS v1, o_orderkey * 57 % 256 AS v2,
        CASE WHEN (CAST(floor(o_orderkey % 2500 / 250) AS BIGINT) * 2 + CAST(floor(o_orderkey % 50 / 5) AS BIGINT)) % 3 = 0 THEN 1 ELSE 0 END AS lab FROM {orders}""",
    "probs": "SELECT vec_id, embedding, label FROM {embeddings}",
    "lines": """SELECT o_orderkey AS line_id, o_orderkey * 7 % 60 + CAST(floor(o_orderkey / 900) AS BIGINT) * 100 AS x0, o_orderkey * 11 % 60 AS y0,
        o_orderkey * 7 % 60 + CAST(floor(o_orderkey / 900) AS BIGINT) * 100 + o_orderkey % 3 AS x1, o_orderkey * 11 % 60 + 1 + o_orderkey % 2 AS y1 FROM {orders}""",
    "streets": """SELECT o_orderkey AS line_id, o_orderkey * 7 % 61 AS x0, o_orderkey * 13 % 67 + CAST(floor(o_orderkey / 900) AS BIGINT) * 1000 AS y0,
        o_orderkey * 7 % 61 + o_orderkey % 4 AS x1, o_orderkey * 13 % 67 + CAST(floor(o_orderkey / 900) AS BIGINT) * 1000 + 1 + o_orderkey % 3 AS y1 FROM {orders}""",
    "parcels": """SELECT p_partkey AS id, p_partkey * 13 % 400 AS minx, p_partkey * 29 % 400 AS miny, p_partkey * 13 % 400 + 3 + p_partkey % 9 AS maxx,
        p_partkey * 29 % 400 + 3 + p_partkey % 7 AS maxy, CAST(p_size % 5 + 1 AS BIGINT) AS damage_class FROM {part}""",
    "triangles": """SELECT p_partkey AS id, p_partkey * 13 % 400 AS x0, p_partkey * 29 % 400 AS y0, p_partkey * 13 % 400 + 3 + p_partkey % 9 AS x1, p_partkey * 29 % 400 + p_partkey % 4 AS y1,
        p_partkey * 13 % 400 + p_partkey % 5 AS x2, p_partkey * 29 % 400 + 3 + p_partkey % 7 AS y2 FROM {part}""",
    "bent_lines": """SELECT o_orderkey AS id, o_orderkey * 7 % 400 AS x0, o_orderkey * 11 % 400 AS y0, o_orderkey * 7 % 400 + 5 + o_orderkey % 6 AS x1, o_orderkey * 11 % 400 + o_orderkey % 5 - 2 AS y1,
        o_orderkey * 7 % 400 + 5 + o_orderkey % 6 + o_orderkey % 4 AS x2, o_orderkey * 11 % 400 + o_orderkey % 5 + 4 AS y2 FROM {orders}""",
    "sizes": "SELECT p_partkey AS img_id, 200 + p_partkey * 37 % 900 AS h, 200 + p_partkey * 53 % 900 AS w FROM {part}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def oracle(query: str) -> str:
    """``query`` with the fixtures it names in front."""
    used = [n for n in SQL if n in query.replace("(", " ").replace(")", " ").replace(",", " ").split()]
    plain = {n: SQL[n].format(**{t: t for t in TABLES}) for n in used}
    head = ", ".join(f"{n} AS ({s})" for n, s in plain.items())
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
