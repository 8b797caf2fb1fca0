"""Line deduplication over levelled sorted runs of line hashes.

The index of line keys (128-bit hashes) is a set of runs, bucketed and sorted by key, in levels; no key is in two runs.  A
batch is merged with the runs: keys that none holds (the anti-join) become a run of level 0, the others only leave their
counts among the updates.  When a level holds ``fanout`` runs they are compacted into one of the next level, updates and
all.  Most lines occur once, so updates are few, and only their keys and those common within a batch can be common at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

KEY = ["k1", "k2"]
STRIP = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 32 << 20  # of text a bucket of the runs, at most spark.sql.shuffle.partitions buckets


class LineRuns:
    """Levelled sorted runs of (k1, k2, n_docs, holder); each table also holds, marked ``seen``, its batch's updates."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout, self.levels, self.batches = spark, fanout, {}, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[DataFrame]:
        return [r for level in self.levels.values() for r in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        """Adds a table, each key of it in one bucket's one sorted file, and compacts a full level."""
        name, path = f"veridune_run_{uuid.uuid4().hex}", store.new_path(self.spark, f"run{level}")
        dealt = rows.select(*KEY, "n_docs", "holder", "seen").repartition(self.buckets, *KEY)
        dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        table = self.spark.table(name)
        table._veridune = (name, path)
        self.levels.setdefault(level, []).append(table)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            both = reduce(DataFrame.unionByName, old)
            # fresh keys are disjoint between runs, so they are merged as they are; updates of one key become one row
            updates = both.where("seen").groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"), F.lit(True).alias("seen"))
            self._write(both.where("not seen").unionByName(updates), level + 1)
            for t in old:
                self.spark.sql(f"DROP TABLE {t._veridune[0]}")
                store.remove(self.spark, t._veridune[1])

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (k1, k2, n_docs, holder) rows."""
        rows = batch.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder")).repartition(self.buckets, *KEY)
        known = [t.where("not seen").select(*KEY, F.lit(True).alias(f"seen{i}")) for i, t in enumerate(self.tables())]
        for t in known:
            rows = rows.join(t.hint("merge"), KEY, "left")
        self._write(rows.withColumn("seen", F.coalesce(*[F.col(f"seen{i}") for i in range(len(known))], F.lit(False))), 0)
        self.batches += 1

    def common(self, least: int) -> DataFrame:
        """(k1, k2, n_docs, holder) of keys that ``least`` documents hold."""
        if not self.tables():
            return self.spark.createDataFrame([], "k1 long, k2 long, n_docs long, holder long")
        both = reduce(DataFrame.unionByName, self.tables())
        updates = both.where("seen").groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("holder").alias("top"))
        own = both.where("not seen").join(updates, KEY, "left")
        found = own.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "top").alias("holder"))
        return found.where(F.col("n_docs") >= least)


def _digests(raw: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and the key digest of each long one."""
    lines = raw.split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        if len(line) >= min_chars:
            key = line.strip(STRIP).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                out.append(xxhash.xxh3_128_digest(key))
                continue
        out.append(None)
    return lines, out


def _keys(text: str, id_col: str, min_chars: int, batches_n: int):
    """A row a block and key: rows that hold it, greatest id, and the batch it belongs to."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                t = store.load(payload.as_buffer())
                buf, off = store.texts_of(t, text)
                raw, counts, holder = buf.tobytes(), {}, {}
                for i, d in enumerate(store.ids_of(t, id_col).tolist()):
                    for k in {k for k in _digests(raw[off[i] : off[i + 1]], min_chars)[1] if k}:
                        counts[k] = counts.get(k, 0) + 1
                        if holder.get(k, d) <= d:
                            holder[k] = d
                if counts:
                    k = np.frombuffer(b"".join(counts), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), block)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(list(counts.values()), pa.int64()), pa.array([holder[x] for x in counts], pa.int64()), pa.array(np.full(len(k), xxhash.xxh64_intdigest(str(block)) % batches_n, np.int32))],
                        names=["block", "k1", "k2", "n_docs", "holder", "batch"],
                    )

    return rows


def _holders(text: str, id_col: str, min_chars: int):
    """(k1, k2, id), once a block, of the keys listed beside each block."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, drop in zip(batch["payload"], batch["drop"], strict=True):
                t = store.load(payload.as_buffer())
                buf, off = store.texts_of(t, text)
                raw = buf.tobytes()
                k = np.array([(x["k1"], x["k2"]) for x in drop.as_py() or ()], "<i8").reshape(-1, 2).tobytes()
                listed = {k[i : i + 16] for i in range(0, len(k), 16)}
                pairs = {(x, d) for i, d in enumerate(store.ids_of(t, id_col).tolist()) for x in _digests(raw[off[i] : off[i + 1]], min_chars)[1] if x in listed}
                k = np.frombuffer(b"".join(x for x, _ in pairs), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array([d for _, d in pairs], pa.int64())], names=["k1", "k2", "id"])

    return rows


def _drop(text: str, id_col: str, min_chars: int, out_schema: pa.Schema, counted: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, drop in zip(batch["payload"], batch["drop"], strict=True):
                t = store.load(payload.as_buffer())
                buf, off = store.texts_of(t, text)
                raw, ids = buf.tobytes(), store.ids_of(t, id_col).tolist()
                k = np.array([(x["k1"], x["k2"]) for x in drop.as_py() or ()], "<i8").reshape(-1, 2).tobytes()
                holder = {k[16 * i : 16 * i + 16]: x["holder"] for i, x in enumerate(drop.as_py() or ())}
                kept, n_lines, n_dropped = [], [], []
                for i, d in enumerate(ids):
                    lines, keys = _digests(raw[off[i] : off[i + 1]], min_chars)
                    stay = [line for line, key in zip(lines, keys, strict=True) if key is None or holder.get(key, d) == d]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                kept = pa.array(kept, pa.binary()).cast(pa.string())
                if counted:
                    cols = [store.id_array(np.array(ids, np.int64)), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept]
                else:
                    null = t[text].is_null().combine_chunks() if isinstance(t[text], pa.ChunkedArray) else t[text].is_null()
                    kept = pc.if_else(null, pa.scalar(None, pa.string()), kept)
                    cols = [kept if f.name == text else t[f.name].combine_chunks().cast(f.type) if not isinstance(t[f.name].combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(t[f.name].chunks).cast(f.type) for f in out_schema]
                yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    return rows


def batches_for(n_bytes: int) -> int:
    """Batches of a table: one more for each doubling of its text beyond 16 MB, two at least; jobs stay few at any size."""
    return max(2, (max(n_bytes, 1) >> 24).bit_length() + 1)


def _apply(docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int, batches: int | None, fanout: int, counted: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    blocks = store.to_blocks(docs, text)
    size = store.total_bytes(blocks)
    batches = batches or batches_for(size)
    schema = "block long, k1 long, k2 long, n_docs long, holder long, batch int"
    found, path = blocks.select("block", "payload").mapInArrow(_keys(text, id_col, min_chars, batches), schema), store.new_path(spark, "line-keys")
    found.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, fanout, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(4, size // BUCKET_BYTES)))
    for b in range(batches):
        runs.add(found.where(F.col("batch") == b))
    common = store.materialize(runs.common(min_docs).select(*KEY, F.col("holder").alias("top")), "common-lines")

    def listed(keys: DataFrame) -> DataFrame:
        drop = found.select("block", *KEY).join(keys, KEY).groupBy("block").agg(F.collect_list(F.struct("k1", "k2", F.col("top").alias("holder"))).alias("drop"))
        return blocks.select("block", "payload").join(drop, "block", "left")

    twice = docs.groupBy(F.col(f"`{id_col}`")).count().where("count > 1")
    if not twice.isEmpty():  # rows are not documents then: count the distinct ids of what may be common
        pairs = listed(common).mapInArrow(_holders(text, id_col, min_chars), "k1 long, k2 long, id long").distinct()
        common = common.join(pairs.groupBy(*KEY).count().where(F.col("count") >= min_docs).select(*KEY), KEY)
    schema = f"`{id_col}` long, n_lines long, n_dropped long, `{text}` string" if counted else docs.schema
    if counted:
        out = pa.schema([(id_col, pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), (text, pa.string())])
    else:
        out = to_arrow_schema(docs.schema)
    return listed(common).mapInArrow(_drop(text, id_col, min_chars, out, counted), schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """Drops lines whose key is common, but for those of the greatest id holding it.

    A key is the line stripped of [\\x20\\x09-\\x0D] and lower-cased in A-Z; a document counts once.  Keys of ``min_chars``
    code points found in ``min_docs`` documents lose all their lines except in the rows of the greatest id.

    Returns id_col, n_lines, n_dropped, text (lines that stay, joined by \\n).  Null or empty text: one empty line.  Rows with
    one id are one document when counted and are treated alike; rows with a null id are together one document, greater than
    all others.  Texts and lines may have any length.  Further columns, of whatever names, are left out.  Empty table: empty
    result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text}`").cast("string").alias(text))
    return _apply(docs, id_col, text, min_chars, min_docs, batches, fanout, True)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """docs, all columns whatever their names, with the lines that line_dedup drops gone from ``text`` (null stays null)."""
    return _apply(docs, id_col, text, min_chars, min_docs, batches, fanout, False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(length(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(holder) FILTER (holder <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
