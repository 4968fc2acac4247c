"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_LIBC = ctypes.CDLL(None)

#: Texts handed to a worker at once are cut into runs of about this many bytes when results are built.
OUT_BYTES = 8 << 20
#: Rows that go to a worker at once.
BATCH_ROWS = 2000
#: Bytes of a block of a table that tasks fill and :func:`reduce_blocks` folds.
BLOCK_BYTES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` names it. Where that is unset, a folder of this machine is used by a
    session of this machine only; elsewhere it is an error, as executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (the master is {master})")
        root = os.path.join(tempfile.gettempdir(), f"textfold-work-{spark.sparkContext.applicationId}")
    return root


class Scratch:
    """Intermediate tables of one operator in the shared folder. A table can go when what reads it is written."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.paths = spark, f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}", {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here, and lost executors lose nothing. An earlier table of this name goes."""
        old, path = self.paths.get(name), f"{self.root}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths[name] = path
        if old is not None:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        """By Hadoop's file system, as the folder may be one that only Spark reaches."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    return Scratch(df.sparkSession, tag).settle(df, "table")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of a size that leaves memory for long texts, in workers that give freed memory back after each task.

    The session keeps the setting, as plans read it when they run.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give memory that this process has freed back to the system: a worker lives on, for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_batches(df: DataFrame, make: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Apply ``make`` (lists of column values in, lists of column values out) to runs of rows, by Arrow.

    Runs are bounded in rows and in bytes, so that a few very long texts do not
    make one large result.
    """
    out_type = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of(batch):
                columns = make([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_type.types)], schema=out_type)

    return map_arrow(df, run, schema)


def append_batches(df: DataFrame, inputs: list[str], make: Callable[[list[list]], list[list]], added: str) -> DataFrame:
    """``df`` with columns added that ``make`` gives for lists of the values of ``inputs``. The other columns pass by as they are; an added name that one of them has is an error."""
    new = arrow_schema(df.sparkSession, added)
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in new.names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of(batch):
                columns = make([part.column(k).to_pylist() for k in places])
                arrays = [*part.columns, *(pa.array(c, t) for c, t in zip(columns, new.types))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *new.names])

    schema = StructType([*df.schema.fields, *_parse_datatype_string(added).fields])
    return map_arrow(df, run, schema)


def runs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of about ``OUT_BYTES``."""
    if batch.num_rows == 0:
        return
    step = max(1, min(batch.num_rows, int(batch.num_rows * OUT_BYTES / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def bucket_of(column: str, buckets: int):
    """crc32 of a value as text, modulo ``buckets``: the deal of rows into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


#: What tasks send of an array is packed by byte planes, as most of its numbers are small.
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(block: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(block.view(np.uint8).reshape(-1, block.itemsize).T)).to_pybytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data, BLOCK_BYTES), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def block_rows(array: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The blocks of an array that hold anything: their numbers and their packed cells."""
    parts = array.reshape(-1, BLOCK_BYTES // array.itemsize)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.array(some.astype(np.int32)), pa.array([pack(parts[k]) for k in some], pa.binary())


def reduce_blocks(blocks: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str, total: int) -> np.ndarray:
    """Fold arrays that tasks sent as :func:`block_rows`: first many per block, then one. ``total`` bytes in all."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = unpack(cells, dtype)
                held[block] = fold(held[block], new) if block in held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(v) for v in held.values()], pa.binary())], names=["block", "cells"])

    rows = blocks.select("block", "cells")
    once = map_arrow(rows.repartition("block", F.spark_partition_id() % 16), run, "block int, cells binary")
    twice = map_arrow(once.repartition("block"), run, "block int, cells binary")
    out = np.zeros(total // np.dtype(dtype).itemsize, dtype)
    per = BLOCK_BYTES // np.dtype(dtype).itemsize
    for row in twice.collect():  # ``total`` bytes, whatever the input
        out[row["block"] * per : row["block"] * per + per] = unpack(row["cells"], dtype)
    return out
