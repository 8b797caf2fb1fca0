"""Shared work folder, materialised tables and blocks of documents.

A *block* is a run of input rows, about ``block_bytes`` of text, kept as one compressed Arrow stream with an id that is
fixed once written.  Operators that must look at every text more than once work on blocks: what crosses the network is
compressed, repeated content is combined inside a block before any shuffle, and answers come back per block, so that a
key held by a third of all rows costs one row per block and not one row per document.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches

BLOCK_SCHEMA = "block long, n_rows long, n_bytes long, payload binary"
NO_ID = np.iinfo(np.int64).max  # stands for a null id inside operators: after every other id, null again in results


@cache
def _archive() -> str:
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="veridune-"), f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return to


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors that don't share the driver's folders."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")  # payload rows are large
    if not sc.master.startswith("local[") and not getattr(sc, "_veridune_shipped", False):
        sc.addPyFile(_archive())
        sc._veridune_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one of our own in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veridune-work-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/veridune-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors cost one task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridune_path = path
    gc.collect()
    spark._jvm.System.gc()  # lets the context cleaner delete the shuffle files of what was just written
    return out


# -- blocks ---------------------------------------------------------------------------------------------------------


def _large(schema: pa.Schema) -> pa.Schema:
    kinds = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    return pa.schema([pa.field(f.name, kinds.get(f.type, f.type), True) for f in schema])


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _pack(text: str, block_bytes: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            t = pa.concat_tables(held)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | seq], pa.int64()), pa.array([t.num_rows], pa.int64()), pa.array([size], pa.int64()), pa.array([dump(t)], pa.binary())],
                names=["block", "n_rows", "n_bytes", "payload"],
            )
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            t = pa.Table.from_batches([batch]).cast(_large(batch.schema))
            if not t.num_rows:
                continue
            lens = pc.fill_null(pc.binary_length(t[text]), 0).to_numpy().astype(np.int64) + 64
            ends = np.cumsum(lens)
            at = 0
            while at < t.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + block_bytes - size, "right")))
                held.append(t.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
                if size >= block_bytes or at < t.num_rows:
                    yield flush()
        if held:
            yield flush()

    return pack


def to_blocks(docs: DataFrame, text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """Writes docs as blocks, all columns, and reads them back: (block, n_rows, n_bytes, payload)."""
    ship(docs.sparkSession)
    return materialize(docs.mapInArrow(_pack(text, block_bytes), BLOCK_SCHEMA), "blocks", "uncompressed")


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.selectExpr("coalesce(sum(n_bytes), 0)").first()[0])


def ids_of(table: pa.Table, id_col: str) -> np.ndarray:
    return pc.fill_null(table[id_col].cast(pa.int64()), NO_ID).to_numpy()


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def texts_of(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null text is empty."""
    col = table[text].combine_chunks() if isinstance(table[text], pa.ChunkedArray) else table[text]
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]
