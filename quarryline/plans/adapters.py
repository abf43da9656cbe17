"""The driver's tables in the shape that operators take. Adapter text is plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.session import many_tasks

#: Album names that tell their date in every way, and some in none.
ALBUM = """CASE o_orderkey % 11
 WHEN 0 THEN 'Beach ' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0')
 WHEN 1 THEN 'July 4th ' || CAST(year(o_orderdate) AS STRING)
 WHEN 2 THEN ' Christmas ' || CAST(year(o_orderdate) AS STRING) || ' '
 WHEN 3 THEN 'easter' || CAST(year(o_orderdate) AS STRING)
 WHEN 4 THEN 'Halloween ' || CAST(year(o_orderdate) AS STRING)
 WHEN 5 THEN CASE month(o_orderdate) % 4 WHEN 0 THEN 'Sept ' WHEN 1 THEN 'jan. ' WHEN 2 THEN 'JUNE ' ELSE 'Trip March ' END || CAST(year(o_orderdate) AS STRING)
 WHEN 6 THEN CASE month(o_orderdate) % 4 WHEN 0 THEN 'Winter ' WHEN 1 THEN 'spring ' WHEN 2 THEN 'Summer ' ELSE 'Harvest ' END || CAST(year(o_orderdate) AS STRING)
 WHEN 7 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST((year(o_orderdate) + o_orderkey % 2 + 1) % 100 AS STRING), 2, '0')
 WHEN 8 THEN 'Family ' || CAST(year(o_orderdate) AS STRING)
 WHEN 9 THEN 'Misc 2001-13-45 x' || CAST(o_orderkey % 7 AS STRING)
 ELSE 'Stuff' END"""

SHAPES = {
    "album_orders": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_ts, CAST(o_orderdate AS DATE) AS o_day, {ALBUM} AS album FROM orders",
    "records": """SELECT l_orderkey, l_linenumber, 'p' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS store_name,
        CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'failed' WHEN l_returnflag = 'R' THEN 'resumed' ELSE 'converted' END AS status,
        CAST(l_tax * 100 AS INT) % 3 AS n_warnings, l_discount < 0.03 AS is_undated,
        CASE l_suppkey % 4 WHEN 0 THEN 'folder' WHEN 1 THEN 'import-stamp' WHEN 2 THEN 'embedded-scan-date' END AS date_source,
        CASE l_linenumber WHEN 1 THEN 'identity' WHEN 2 THEN 'crop' WHEN 3 THEN 'rotate' ELSE ' ' END AS transform_status,
        'album ' || CAST(l_suppkey % 30 AS STRING) AS album,
        CASE WHEN l_suppkey % 5 > 0 THEN md5(CAST(l_partkey AS STRING)) END AS pixel_sha256 FROM lineitem""",
    "file_sources": """SELECT md5(coalesce(text, '')) AS sha256, source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'DCP_0' ELSE 'scan ' END || CAST(doc_id AS STRING) || '.FPX' AS relpath,
        CASE WHEN doc_id % 3 = 0 THEN 'DCP_0' ELSE 'scan ' END || CAST(doc_id AS STRING) || '.FPX' AS name, CAST(n_chars AS BIGINT) AS size FROM documents""",
    "before_tree": "SELECT doc_id AS k, CASE WHEN doc_id % 17 = 3 THEN 'gone/' ELSE source || '/' END || CAST(doc_id AS STRING) AS path, n_chars AS size, n_chars * 1000 AS mtime_ns FROM documents",
    "after_tree": "SELECT doc_id AS k, CASE WHEN doc_id % 19 = 4 THEN 'new/' ELSE source || '/' END || CAST(doc_id AS STRING) AS path, n_chars + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END AS size, n_chars * 1000 + CASE WHEN doc_id % 29 = 1 THEN 7 ELSE 0 END AS mtime_ns FROM documents",
    "frames": """SELECT p_partkey, 100 + p_size * 7 AS width, 80 + p_size * 5 AS height,
        CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 4 THEN 0.0 ELSE CAST(100 + p_size * 7 AS DOUBLE) / (80 + p_size * 5) * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.5 END END AS aspect,
        CASE p_partkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 WHEN 4 THEN 0.9 WHEN 5 THEN 2.0 ELSE 1.0 END AS m0,
        CASE WHEN p_partkey % 7 = 1 THEN -1.0 ELSE 0.0 END AS m1,
        CASE p_partkey % 7 WHEN 2 THEN 0.125 WHEN 3 THEN 0.0625 WHEN 5 THEN -0.25 ELSE 0.0 END AS m3,
        CASE WHEN p_partkey % 7 = 1 THEN 1.0 ELSE 0.0 END AS m4,
        CASE p_partkey % 7 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 WHEN 4 THEN 0.8 WHEN 5 THEN 2.0 ELSE 1.0 END AS m5,
        CASE p_partkey % 7 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 ELSE 0.0 END AS m7, p_partkey % 11 > 0 AS has_matrix FROM part""",
}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table a shape's text makes of the driver's tables, without registering any view."""
    text = SHAPES[name]
    table = text.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=read(spark, sf_dir, table))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table's rows over all cores: a small file is one task, however much a query makes of each of its rows."""
    return read(spark, sf_dir, table).repartition(many_tasks(spark), key)


def with_shapes(*shapes: str) -> str:
    """The shapes as common table expressions for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SHAPES[n]})" for n in shapes) + " "
