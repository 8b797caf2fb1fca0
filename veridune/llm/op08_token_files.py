"""Token-id files: whole texts as ids, in ascending id order, range-coded, read back from the files.

A file image (mixcoder.py) is one row of a Parquet table in the shared folder, beside its documents' ids and lengths, so
that files can be written and read wherever Spark can write and read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mixcoder, store
from .units import default_path, encoder

#: blocks side by side; a step over twice the blocks costs much less than two steps
WIDE = 4 * mixcoder.LANES
FILE_SCHEMA = "file long, n_ids long, docs array<long>, sizes array<long>, image binary"


def _list(parts: list[np.ndarray]) -> pa.Array:
    """One row: the list of all parts' values."""
    values = np.concatenate(parts).astype(np.int64)
    return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), pa.array(values))


def _files(path: str | None, end: int, most: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path or default_path("byte_bpe_50k.json"), "bytes")
        part, seq = TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal seq, docs, sizes, parts, held
            image = mixcoder.encode(np.concatenate(parts), lanes=WIDE)
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) | seq]), pa.array([held]), _list(docs), _list(sizes), pa.array([image], pa.binary())], names=["file", "n_ids", "docs", "sizes", "image"])
            seq, docs, sizes, parts, held = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            ids, n = enc.ids(batch["text"], end)
            d, to, a = batch["id"].to_numpy(), np.cumsum(n), 0
            while a < len(n):
                base = int(to[a - 1]) if a else 0
                b = min(len(n), int(np.searchsorted(to, base + most - held)) + 1)  # with the document that fills the file
                docs.append(d[a:b])
                sizes.append(n[a:b])
                parts.append(ids[base : to[b - 1]])
                held += int(to[b - 1]) - base
                a = b
                if held >= most:
                    yield flush()
        if docs:
            yield flush()

    return rows


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, docs, sizes, image in zip(batch["first"].to_pylist(), batch["docs"], batch["sizes"], batch["image"], strict=True):
            ids = mixcoder.decode(image.as_py(), lanes=WIDE).tobytes()
            n = sizes.values.to_numpy()
            to = np.cumsum(n)
            crc = [zlib.crc32(ids[4 * (b - k) : 4 * b]) for b, k in zip(to.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([store.id_array(docs.values.to_numpy()), pa.array(first + to - n), pa.array(n), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = 2, tokenizer: str | None = None, most: int = mixcoder.LANES * mixcoder.BLOCK) -> None:
    """Writes docs' ids under path: files in ascending id order, each of whole documents and about ``most`` ids.

    Null text: empty, so the end id alone.  Null ids come last; rows with one id stand side by side, in no given order.
    """
    spark = docs.sparkSession
    store.ship(spark)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(store.NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(n, "id").sortWithinPartitions("id")
    ordered.mapInArrow(_files(tokenizer, end, most), FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row a document, decoded from the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    store.ship(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts = files.select("file", "n_ids").withColumn("first", F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).select("file", "first")
    out = files.join(starts, "file").select("first", "docs", "sizes", "image").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
