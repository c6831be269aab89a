"""Lenses: views that derive node, frame, mask, pixel and ledger tables from the given tables.

Each lens has a DataFrame form and a DuckDB form (a WITH item) of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeleton nodes: one tree per user of ``events``."""
    w = "over (partition by user_id order by ts, event_id)"
    return (
        table(spark, sf_dir, "events")
        .selectExpr("event_id", "user_id", "event_type", "value", "datediff(to_date(ts), date'2024-01-01') as day",
                    f"row_number() {w} as seq", f"lag(event_id) {w} as p1", f"lag(event_id, 2) {w} as p2")
        .selectExpr(
            "event_id as node_id", "concat('U', user_id) as cell_name",
            "if(event_type = 'error' and p2 is not null, p2, p1) as parent_id",
            "value as x", "cast(event_id * 37 % 1000 as double) as y",
            "cast(if(user_id % 2 = 1, 29 - day, day) as bigint) as z",
            """case when event_id % 17 = 0 then 0 when user_id % 5 = 0 then 10000 + user_id div 10
               when event_id % 29 = 0 then 20000 + user_id div 3 else user_id * 100 + seq div 16 + 1 end as label""",
        )
    )


NODES = """
n0 AS (SELECT event_id, user_id, event_type, value, date_diff('day', DATE '2024-01-01', ts::DATE) AS day,
  row_number() OVER w AS seq, lag(event_id) OVER w AS p1, lag(event_id, 2) OVER w AS p2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
nodes AS (SELECT event_id AS node_id, 'U' || user_id AS cell_name,
  CASE WHEN event_type = 'error' AND p2 IS NOT NULL THEN p2 ELSE p1 END AS parent_id,
  value AS x, (event_id * 37 % 1000)::DOUBLE AS y,
  (CASE WHEN user_id % 2 = 1 THEN 29 - day ELSE day END)::BIGINT AS z,
  CASE WHEN event_id % 17 = 0 THEN 0 WHEN user_id % 5 = 0 THEN 10000 + user_id // 10
    WHEN event_id % 29 = 0 THEN 20000 + user_id // 3 ELSE user_id * 100 + seq // 16 + 1 END AS label FROM n0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of chains with one run per mask."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as neuron", "user_id as chain_idx",
        "1499L + row_number() over (partition by event_type, user_id order by ts, event_id) as z",
        "if(event_id % 23 = 0, 0L, cast(floor(value) as bigint) + 5) as area", "event_id % 400 as x0",
        "if(event_id % 7 = 0, null, (event_id % 100) / 100.0D) as pred_iou",
        "if(event_id % 3 = 0, null, event_id % 8 <> 0) as skeleton_contained",
    )


FRAMES = """
frames AS (SELECT event_type AS neuron, user_id AS chain_idx,
  1499 + row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS z,
  CASE WHEN event_id % 23 = 0 THEN 0 ELSE floor(value)::BIGINT + 5 END AS area, event_id % 400 AS x0,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS pred_iou,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 8 <> 0 END AS skeleton_contained FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as slice", "l_suppkey % 10 as seg", "l_partkey % 12 as gt")


PIXELS = "pixels AS (SELECT l_linenumber AS slice, l_suppkey % 10 AS seg, l_partkey % 12 AS gt FROM lineitem)"


def raw_runs(spark: SparkSession, sf_dir: str, truth: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 20 as slice", "p_brand as neuron", "p_partkey div 20 % 40 as y", "p_partkey * 13 % 90 as x0",
        "p_partkey * 13 % 90 + p_size as x1", "p_partkey")
    if truth:
        return rows.filter("p_partkey % 6 <> 0").selectExpr("slice", "neuron", "y", "x0 + 3 as x0", "x1 + 5 as x1")
    return rows.drop("p_partkey")


def _runs_sql(name: str, truth: bool) -> str:
    a, b, where = (" + 3", " + 5", " WHERE p_partkey % 6 <> 0") if truth else ("", "", "")
    return f"""
{name}_raw AS (SELECT p_partkey % 20 AS slice, p_brand AS neuron, p_partkey // 20 % 40 AS y, p_partkey * 13 % 90{a} AS x0,
  p_partkey * 13 % 90 + p_size{b} AS x1 FROM part{where}),
{name}_new AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY slice, neuron, y ORDER BY x0, x1
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {name}_raw),
{name}_isl AS (SELECT *, sum(fresh) OVER (PARTITION BY slice, neuron, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_new),
{name} AS (SELECT slice, neuron, y, min(x0) AS x0, max(x1) AS x1 FROM {name}_isl GROUP BY slice, neuron, y, isl)"""


RUNS, TRUTH = _runs_sql("pred", False), _runs_sql("truth", True)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('N', o_custkey) as neuron",
        "cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as chain_idx",
        """case o_orderstatus when 'F' then 'done' when 'P' then 'flagged' else
           element_at(array('failed', 'pending', 'running'), cast(o_orderkey % 3 as int) + 1) end as status""",
    )


MANIFEST = """
manifest AS (SELECT 'N' || o_custkey AS neuron,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chain_idx,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'flagged' ELSE
    ['failed', 'pending', 'running'][(o_orderkey % 3)::INT + 1] END AS status FROM orders)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('N', user_id) as neuron", "event_id % 15 as chain_idx", "ts", "event_id as seq",
        """case event_type when 'view' then 'in_review' when 'click' then 'approved' when 'error' then 'rejected'
           when 'purchase' then 'corrected' else 'unreviewed' end as review""",
    )


REVIEWS = """
reviews AS (SELECT 'N' || user_id AS neuron, event_id % 15 AS chain_idx, ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'in_review' WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected'
    WHEN 'purchase' THEN 'corrected' ELSE 'unreviewed' END AS review FROM events)"""


def chain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of chains' masks, each in the space that its chain's state names; they may overlap."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 20 as slice", "p_brand as neuron", "p_partkey % 7 as chain_idx", "p_partkey div 20 % 40 as y",
        "p_partkey * 13 % 90 as x0", "p_partkey * 13 % 90 + p_size as x1")


def chain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved state of each chain, from its first customer: a crop window of some scale, or none."""
    first = "concat('Brand#', 1 + c_custkey % 5, 1 + c_custkey div 5 % 5) as neuron", "c_custkey % 7 as chain_idx", "c_custkey as k"
    window = """named_struct('origin_tif', array(k * 37 % 1100 - 200 + 0.5D, k * 29 % 330 - 90 + 0.25D),
        'size_tif', array(cast((145 + k % 4) * (2 + k % 4) as int), cast((40 + k % 3) * (2 + k % 4) as int)),
        'crop_scale', cast(2 + k % 4 as int), 'sam_scale', 8)"""
    rows = table(spark, sf_dir, "customer").selectExpr(*first).groupBy("neuron", "chain_idx").min("k").withColumnRenamed("min(k)", "k")
    return rows.selectExpr("neuron", "chain_idx", f"if(k % 6 = 0, null, {window}) as crop_window")


CHAIN_RUNS = """chain_runs AS (SELECT p_partkey % 20 AS slice, p_brand AS neuron, p_partkey % 7 AS chain_idx, p_partkey // 20 % 40 AS y, p_partkey * 13 % 90 AS x0,
  p_partkey * 13 % 90 + p_size AS x1 FROM part)"""
CHAIN_STATES = """
chain_k AS (SELECT 'Brand#' || (1 + c_custkey % 5) || (1 + c_custkey // 5 % 5) AS neuron, c_custkey % 7 AS chain_idx, min(c_custkey) AS k FROM customer GROUP BY ALL),
chain_states AS (SELECT neuron, chain_idx, k * 37 % 1100 - 200 + 0.5::DOUBLE AS ox, k * 29 % 330 - 90 + 0.25::DOUBLE AS oy,
  (145 + k % 4) * (2 + k % 4) AS w, (40 + k % 3) * (2 + k % 4) AS h, 2 + k % 4 AS scale FROM chain_k WHERE k % 6 <> 0)"""


NODE_LABEL_SQL = "'L' || substr(cell_name, 2)::BIGINT % 12 || '.' || substr(cell_name, 2)::BIGINT // 12 % 3"


def labelled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the label of the neuron that several cells of ``nodes`` share."""
    n = "cast(substring(cell_name, 2) as bigint)"
    return nodes(spark, sf_dir).selectExpr("node_id", "z", "x", "y", f"concat('L', {n} % 12, '.', {n} div 12 % 3) as label")


def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of segments: a brand within a block of the parts that fill each image row once."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 20 as slice", "concat(p_brand, '.', p_partkey div 800) as segment", "p_partkey div 20 % 40 as y",
        "p_partkey * 13 % 90 as x0", "p_partkey * 13 % 90 + p_size as x1")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each segment; a label has several."""
    of = "concat('L', cast(substring(p_brand, 7) as bigint) % 12, '.', p_partkey div 800) as label"
    return table(spark, sf_dir, "part").selectExpr("concat(p_brand, '.', p_partkey div 800) as segment", of).distinct()


SEGMENT_RUNS = """segment_runs AS (SELECT p_partkey % 20 AS slice, p_brand || '.' || p_partkey // 800 AS segment, p_partkey // 20 % 40 AS y, p_partkey * 13 % 90 AS x0, p_partkey * 13 % 90 + p_size AS x1 FROM part),
segments AS (SELECT DISTINCT p_brand || '.' || p_partkey // 800 AS segment, 'L' || substr(p_brand, 7)::BIGINT % 12 || '.' || p_partkey // 800 AS label FROM part)"""
