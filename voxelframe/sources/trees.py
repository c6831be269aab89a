"""A data source for trees of masks or label rasters in PNG files, pruned by path.

    trees.read(spark, "/data/run").filter("neuron = 'AVAL'")

The tree is ``<root>/<neuron>/chain_<k>/masks/mask_<z>.png`` or ``<root>/<neuron>/<z>.png`` (chain 0), rows are
neuron, chain_idx, slice, label, y, x0, x1.  Every folder of masks is a partition of the scan.  Filters on
neuron, chain_idx and slice (=, IN, <, <=, >, >=) choose folders and files before any is opened, where Spark
pushes filters to Python sources (``spark.sql.python.filterPushdown.enabled``, which ``register`` sets); else
Spark applies them itself.  A task reads its files one by one, so it holds one raster at a time.

``read`` adds a filter that all rows meet.  Without one, Spark 4.1 would let a frame that is used again without
filters keep those of its last use; so take ``read`` rather than the bare format.

The root is a path or an address that pyarrow can open.  Options: ``binary`` (true: every pixel above 0 has the
label 1; false: labels as they are).  A folder without such files gives nothing; a file that can't be read
fails its task, which Spark tries again.  ``write`` is the way back: a file per frame.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxelframe.sources.rasters import RUNS_AT_ONCE, decoded, encoded, runs_of

SCHEMA = "neuron string, chain_idx bigint, slice bigint, label bigint, y bigint, x0 bigint, x1 bigint"
_FILE = re.compile(r"(?:mask_)?0*(\d+)\.png$")
_TESTS = {
    EqualTo: operator.eq, In: lambda x, values: x in values, LessThan: operator.lt, LessThanOrEqual: operator.le,
    GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
}


@dataclass
class Folder(InputPartition):
    neuron: str
    chain_idx: int
    files: list[tuple[int, str]] = field(default_factory=list)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.binary = options["path"], options.get("binary", "true").lower() == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("neuron",), ("chain_idx",), ("slice",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _keeps(self, name: str, value: object) -> bool:
        return all(_TESTS[kind](value, wanted) for column, kind, wanted in self.tests if column == name)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _listed(self, store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
        return sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path)

    def partitions(self) -> list[Folder]:
        store, root = self._store()
        out = []
        for neuron in self._listed(store, root):
            if neuron.type != fs.FileType.Directory or not self._keeps("neuron", neuron.base_name):
                continue
            inside = self._listed(store, neuron.path)
            places = [(0, inside)]
            for chain in inside:
                number = re.fullmatch(r"chain_(\d+)", chain.base_name)
                if number and chain.type == fs.FileType.Directory and self._keeps("chain_idx", int(number[1])):
                    places.append((int(number[1]), self._listed(store, f"{chain.path}/masks")))
            for k, infos in places:
                named = [(int(m[1]), i.path) for i in infos if i.is_file and (m := _FILE.fullmatch(i.base_name))]
                files = [(z, path) for z, path in named if self._keeps("slice", z)]
                if files and self._keeps("chain_idx", k):
                    out.append(Folder(neuron.base_name, k, files))
        return out

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Folder):  # no folder was found
            return
        store, _ = self._store()
        for z, path in partition.files:
            with store.open_input_file(path) as file:
                pixels = decoded(file.read())
            table = runs_of((pixels > 0).astype(np.uint16) if self.binary else pixels).astype(np.int64)
            for k in range(0, len(table), RUNS_AT_ONCE):
                part = table[k : k + RUNS_AT_ONCE]
                same = lambda v, t: pa.repeat(pa.scalar(v, t), len(part))  # noqa: B023, E731
                columns = [same(partition.neuron, pa.string()), same(partition.chain_idx, pa.int64()), same(z, pa.int64())]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(part[:, c]) for c in range(4)], names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TreeWriter(DataSourceArrowWriter):
    """Writes rows that come sorted by neuron, chain_idx and slice, one raster at a time.  A file appears whole or
    not at all; a task that is done again writes the same files again."""

    def __init__(self, options: dict):
        self.options, self.binary = options, options.get("binary", "true").lower() == "true"
        self.shape = int(options["height"]), int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = TreeReader(self.options)._store()
        at, pixels, files = None, None, []

        def close() -> None:
            if at is None:
                return
            neuron, chain, z = at
            folder = f"{root}/{neuron}/chain_{chain:02d}/masks"
            store.create_dir(folder, recursive=True)
            path = f"{folder}/mask_{z:04d}.png"
            with store.open_output_stream(f"{path}.part") as file:
                file.write(encoded((pixels > 0).astype(np.uint8) * np.uint8(255) if self.binary else pixels))
            store.move(f"{path}.part", path)
            files.append(path)

        for batch in iterator:
            names = zip(*(batch.column(c).to_pylist() for c in ("neuron", "chain_idx", "slice")))
            spans = zip(*(batch.column(c).to_pylist() for c in ("label", "y", "x0", "x1")))
            for name, (label, y, x0, x1) in zip(names, spans):
                if name != at:
                    close()
                    at, pixels = name, np.zeros(self.shape, np.uint16)
                if 0 <= y < self.shape[0] and x1 > 0:
                    part = pixels[y, max(0, x0) : x1]
                    np.maximum(part, label, out=part)  # of several objects the highest number has a pixel
        close()
        return Written(files)


class MaskTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mask_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("mask_tree")`` known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MaskTree)


def read(spark: SparkSession, root: str, binary: bool = True) -> DataFrame:
    """Runs of all masks (or, not ``binary``, of all labels) of the tree."""
    register(spark)
    return spark.read.format("mask_tree").option("binary", str(binary).lower()).load(root).filter("slice >= 0")


def write(runs: DataFrame, frames: DataFrame, root: str, shape: tuple[int, int], binary: bool = True) -> DataFrame:
    """Writes a raster of (rows, columns) for every frame (neuron, chain_idx, slice) that has runs (with label, y, x0,
    x1), as masks of 0 and 255 or with labels, of which the highest wins.  Files that are there stay or are
    replaced.  Gives back, per chain, how many frames were written and how many were skipped for want of an object.
    Runs of other frames are left out; to write at another size, resample the runs first."""
    spark, key = runs.sparkSession, ["neuron", "chain_idx", "slice"]
    register(spark)
    frames = frames.select(*key).distinct()
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]
    dealt = runs.join(frames, key, "left_semi").select(*columns).repartition(*key).sortWithinPartitions(*key)
    out = dealt.write.format("mask_tree").mode("append").option("binary", str(binary).lower())
    out.option("height", shape[0]).option("width", shape[1]).save(root)
    seen = runs.select(*key).distinct().withColumn("seen", F.lit(1))
    counts = frames.join(seen, key, "left").groupBy("neuron", "chain_idx")
    return counts.agg(F.count("seen").alias("n_written"), (F.count("*") - F.count("seen")).alias("n_skipped"))
