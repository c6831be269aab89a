"""Tables from files and back: node tables, states, checks, shards, registrations, ledgers, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions import names
from voxelframe.operators import ledgers, registration, segments

_CHAIN = r"([^/]+)/chain_(\d+)/[^/]+$"


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """A node table from CSV: ids in their plain form, rows without a place left out."""
    raw = spark.read.option("header", True).csv(path)
    number = [F.expr(f"try_cast({c} as double)").alias(c) for c in "xyz"]
    others = [c for c in raw.columns if c not in ("node_id", "parent_id", "cell_name", "x", "y", "z")]
    ids = [names.canon_id(F.col(c)).alias(c) for c in ("node_id", "parent_id")]
    return raw.select(*ids, names.normalize_name(F.col("cell_name")).alias("cell_name"), *number, *others).dropna(subset=["x", "y", "z"])


def pulled_nodes(dumps: DataFrame) -> DataFrame:
    """Node rows of dumped skeletons: ``rows`` is a JSON array of arrays (node, parent, confidence, x, y, z),
    in nanometres; places become pixels."""
    row = F.explode(F.from_json("rows", "array<array<string>>"))
    at = dumps.select("cell_name", row.alias("r"))
    place = [(F.expr(f"try_cast(r[{k}] as double)") / size).alias(c) for c, k, size in (("x", 3, 2.0), ("y", 4, 2.0), ("z", 5, 50.0))]
    return at.select(names.canon_id(F.col("r")[0]).alias("node_id"), names.canon_id(F.col("r")[1]).alias("parent_id"), "cell_name", *place)


def segment_table(spark: SparkSession, path: str) -> DataFrame:
    return segments.parsed(spark.read.text(path).withColumnRenamed("value", "line"))


def _of_chain(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, _CHAIN, 1).alias("neuron_dir"), F.regexp_extract(path, _CHAIN, 2).cast("long").alias("chain_idx"))


def states(spark: SparkSession, root: str, schema) -> DataFrame:
    """The saved states of all chains below a folder, with frame numbers as whole numbers; a broken file is
    a row of nulls."""
    raw = _of_chain(spark.read.text(f"{root}/*/chain_*/state.json", wholetext=True))
    return ledgers.states(raw.withColumnRenamed("value", "json"), schema)


_CONFIG = "config struct<model_size:string,scale:int,save_downscale:int,chain_crop:boolean>"


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """How a prediction was made: the settings in the first state, by path, that can be read; no row if none can."""
    raw = spark.read.text(f"{root}/*/chain_*/state.json", wholetext=True)
    read = raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"_corrupt_record string, neuron string, {_CONFIG}", {"mode": "PERMISSIVE"}).alias("s"))
    known = read.filter("s is not null and s._corrupt_record is null")
    chain = F.regexp_extract("path", r"([^/]+/chain_\d+)/state\.json$", 1).alias("example_chain")
    return known.orderBy("path").limit(1).select("s.config.*", chain)


def write_states(rows: DataFrame, path: str) -> None:
    rows.withColumn("frame_to_z", F.transform_keys("frame_to_z", lambda k, _: k.cast("string"))).write.mode("overwrite").json(path)


def checks(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every chain's qc.csv below a folder in one scan; columns that older files lack are null."""
    return _of_chain(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{root}/*/chain_*/qc.csv"))


def shards(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One ledger from all shards that have it."""
    return spark.read.option("header", True).option("mergeSchema", True).csv(f"{root}/shard_*/{name}")


def screens(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Records of the variants that have one; broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)


_JSON = "A array<array<double>>, offsets array<array<double>>, z_min bigint, affines array<array<array<double>>>"


def registration_json(spark: SparkSession, path: str) -> DataFrame:
    """A fit per section; files without affines give the linear part and the section's offset."""
    r = spark.read.schema(_JSON).option("multiLine", True).json(path)
    at = r.select("A", "affines", "z_min", F.posexplode("offsets").alias("k", "o"))
    own = F.col("affines")[F.col("k")]
    cell = lambda i, j: F.coalesce(own[i][j], F.col("A")[i][j] if j < 2 else F.col("o")[i])
    cells = [cell(i, j).alias(p) for p, (i, j) in zip(registration.PARAMETERS, ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)))]
    return at.select((F.col("z_min") + F.col("k")).alias("z"), *cells)


def write_registration(fit: DataFrame, linear: DataFrame, path: str) -> None:
    """The sections of one registration as one document."""
    rows = fit.groupBy().agg(F.array_sort(F.collect_list(F.struct("z", *registration.PARAMETERS))).alias("rows"))
    rows = rows.select("rows", F.col("rows")[0]["z"].alias("z_min"))
    of = lambda r: F.array(F.array(r["a"], r["b"], r["tx"]), F.array(r["c"], r["d"], r["ty"]))
    document = rows.crossJoin(linear).select(
        F.array(F.array("a", "b"), F.array("c", "d")).alias("A"), F.transform("rows", lambda r: F.array(r["tx"], r["ty"])).alias("offsets"),
        "z_min", F.transform("rows", of).alias("affines"))
    document.coalesce(1).write.mode("overwrite").json(path)


def write_runs(runs: DataFrame, path: str, union: bool = False) -> None:
    """Mask runs by neuron.  With ``union`` what is there already stays: run tables are sets, and readers
    merge what touches."""
    runs.write.mode("append" if union else "overwrite").partitionBy("neuron").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON line per row, after those that are there."""
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
