"""Scene relations derived from the general test tables, as SQL that Spark and DuckDB both run.

In the SQL a table stands in braces: Spark gets the DataFrame, DuckDB the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.visibility import Camera

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VOTES = """SELECT CAST(l_orderkey % 40 AS INT) AS frame_index, CAST(l_suppkey % 8 AS INT) AS instance_id, CAST(l_partkey AS BIGINT) AS gaussian_index, CAST(l_discount AS DECIMAL(12,2)) AS weight FROM {lineitem}"""

POINTS = """SELECT CAST(p_partkey AS BIGINT) AS gaussian_index,
 CAST((p_partkey * 7919) % 1000 AS DOUBLE) / 100 - 5 AS x, CAST((p_partkey * 104729) % 1000 AS DOUBLE) / 100 - 5 AS y, CAST((p_partkey * 611953) % 900 AS DOUBLE) / 100 + 1 AS z,
 CAST(p_size AS DOUBLE) / 5 - 6 AS opacity, CAST(p_size % 7 AS DOUBLE) / 10 - 3 AS scale_0, CAST(p_size % 5 AS DOUBLE) / 10 - 3 AS scale_1, CAST(p_partkey % 9 AS DOUBLE) / 10 - 3 AS scale_2,
 CAST(1 AS DOUBLE) AS rot_0, CAST(0 AS DOUBLE) AS rot_1, CAST(0 AS DOUBLE) AS rot_2, CAST(0 AS DOUBLE) AS rot_3,
 CAST(p_partkey % 11 AS DOUBLE) / 10 AS f_dc_0, CAST(p_partkey % 13 AS DOUBLE) / 10 AS f_dc_1, CAST(p_partkey % 17 AS DOUBLE) / 10 AS f_dc_2, CAST(p_partkey % 3 AS DOUBLE) AS f_rest_0
 FROM {part}"""

CLOUD = """SELECT CAST(vec_id AS BIGINT) AS gaussian_index, embedding[{one}] AS x, embedding[{two}] AS y, embedding[{three}] AS z, CAST(label AS INT) AS label FROM {embeddings}"""

FRAMES = """SELECT CAST(r_regionkey AS INT) AS frame_index, CONCAT('images/frame_', CAST(r_regionkey AS VARCHAR(9)), '.png') AS file_path,
 CAST(1 AS DOUBLE) AS r00, CAST(0 AS DOUBLE) AS r01, CAST(0 AS DOUBLE) AS r02, CAST(0 AS DOUBLE) AS r10, CAST(1 AS DOUBLE) AS r11, CAST(0 AS DOUBLE) AS r12, CAST(0 AS DOUBLE) AS r20, CAST(0 AS DOUBLE) AS r21, CAST(1 AS DOUBLE) AS r22,
 CAST(r_regionkey AS DOUBLE) / 2 - 1 AS t0, CAST(r_regionkey AS DOUBLE) / 4 AS t1, CAST(0 AS DOUBLE) AS t2 FROM {region}"""

INSTANCES = """SELECT CAST(s_suppkey % 5 AS INT) AS frame_index, CAST(s_suppkey AS INT) AS instance_id,
 CASE CAST(s_suppkey % 9 AS INT) WHEN 0 THEN 'Television TV' WHEN 1 THEN 'large chair' WHEN 2 THEN 'coffee table' WHEN 3 THEN 'sofa couch' WHEN 4 THEN 'cabinet shelf' WHEN 5 THEN 'bedside lamp' WHEN 6 THEN 'window' WHEN 7 THEN 'chair table' ELSE NULL END AS label,
 CAST(s_suppkey % 10 AS DOUBLE) / 10 AS score, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST((s_suppkey * 7) % 10 AS DOUBLE) / 10 END AS detection_score,
 CAST((10 + s_suppkey % 20) * (10 + s_suppkey % 15) AS INT) AS area, 100 AS width, 100 AS height,
 CAST((s_suppkey * 17) % 70 AS INT) AS x0, CAST((s_suppkey * 29) % 70 AS INT) AS y0, CAST((s_suppkey * 17) % 70 + 10 + s_suppkey % 20 AS INT) AS x1, CAST((s_suppkey * 29) % 70 + 10 + s_suppkey % 15 AS INT) AS y1,
 CAST(s_suppkey AS INT) AS position FROM {supplier}"""

IDS = """SELECT CAST(o_orderkey AS BIGINT) AS gaussian_index, CAST(o_custkey % 20 AS INT) - 1 AS gt,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 23 AS INT) - 1 WHEN o_custkey % 20 = 0 THEN -1 ELSE CAST(o_custkey % 20 AS INT) + 99 END AS pred FROM {orders}"""

#: Boxes: origin, three edges; corners follow in the usual order 0, x, xy, y, z, xz, xyz, yz.
BOXES = """SELECT CAST(n_nationkey AS INT) AS object_id, n_name AS label,
 CAST((n_nationkey * 7) % 10 AS DOUBLE) - 5 AS ox, CAST((n_nationkey * 3) % 10 AS DOUBLE) - 5 AS oy, CAST((n_nationkey * 5) % 9 AS DOUBLE) + 1 AS oz,
 CAST(1 + n_nationkey % 4 AS DOUBLE) AS ex, CAST(1 + n_nationkey % 3 AS DOUBLE) AS ey, CAST(2 + n_nationkey % 5 AS DOUBLE) AS ez, CAST(n_nationkey % 2 AS DOUBLE) / 2 AS skew FROM {nation}"""

CAMERA = Camera(100.0, 100.0, 50.0, 50.0, 100, 100)


def for_duckdb(sql: str) -> str:
    """The SQL with plain table names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{one}", "1").replace("{two}", "2").replace("{three}", "3")


class Scene:
    """Relations of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {n: self.table(n) for n in TABLES if "{" + n + "}" in text}
        for k, v in (("{one}", "0"), ("{two}", "1"), ("{three}", "2")):  # Spark's arrays count from 0
            text = text.replace(k, v)
        return self.spark.sql(text, **used)

    votes = property(lambda self: self.sql(VOTES))
    points = property(lambda self: self.sql(POINTS))
    cloud = property(lambda self: self.sql(CLOUD))
    frames = property(lambda self: self.sql(FRAMES))
    instances = property(lambda self: self.sql(INSTANCES))
    ids = property(lambda self: self.sql(IDS))
    boxes = property(lambda self: self.sql(BOXES))

    @property
    def mask_pixels(self) -> DataFrame:
        """The pixels of each instance's box."""
        wide = self.instances.select(
            "frame_index", "instance_id", "y0", "y1", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")
        )
        return wide.select("frame_index", "instance_id", "x", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))

    @property
    def box_corners(self) -> DataFrame:
        o, x, y, z = (
            (F.col("ox"), F.col("oy"), F.col("oz")), (F.col("ex"), F.col("skew"), F.lit(0.0)), (F.lit(0.0), F.col("ey"), F.lit(0.0)),
            (F.lit(0.0), F.lit(0.0), F.col("ez"))
        )
        add = lambda *v: F.array(*[sum((e[i] for e in v[1:]), v[0][i]) for i in range(3)])
        return self.boxes.select(
            "object_id", "label",
            F.array(add(o), add(o, x), add(o, x, y), add(o, y), add(o, z), add(o, x, z), add(o, x, y, z), add(o, y, z)).alias("corners")
        )

    @property
    def depth(self) -> DataFrame:
        """A depth map for every frame: smooth, with steps."""
        n = self.spark.range(100)
        grid = n.select(F.col("id").cast("int").alias("px")).crossJoin(n.select(F.col("id").cast("int").alias("py")))
        return self.frames.select("frame_index").crossJoin(F.broadcast(grid)).withColumn(
            "d", (1 + (F.col("px") * 3 + F.col("py") * 7 + F.col("frame_index")) % 40).cast("double") / 8
        )
