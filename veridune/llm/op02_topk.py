"""Exact top-k by inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residuals.

Vectors are rotated onto the right singular vectors of the corpus, so leading coordinates carry most of the length.  For
a query the inner product is at most the partial sum over the leading coordinates plus the product of the two residual
lengths.  Vectors are range-dealt by descending length; a task walks its vectors from long to short and stops for a
query when even the whole lengths cannot reach its k-th score.  Survivors are scored exactly: in integers where they are
few; where they are many, by a product of whole matrices of integer values, in floats while lengths prove every sum to be
exact.  The longest vectors, a stated number, are scored first on the driver to start all tasks with good k-th scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

LEAD = 16
CHUNK = 8192  # queries broadcast at once
STEP = 512  # vectors scored at once
SEED = 2048  # longest vectors that give first thresholds
WAIT = 1 << 16  # results that wait for a sort, at least
DENSE = 32  # where one pair in so many outlives the bound, all of a step's are multiplied at once
EXACT = 2.0**52  # lengths whose product is below it: float sums of integer products are exact
NONE = -(1 << 62)  # below every score, and its negative is a number too


def _matrix(col: pa.Array) -> np.ndarray:
    off = np.asarray(col.offsets)
    return np.asarray(col.values)[off[0] : off[-1]].reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch["v"]).astype(np.float64)
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])


class _Best:
    """k best (score, -id) of each query; what is added waits until it is worth a sort."""

    def __init__(self, n: int, k: int, first: np.ndarray):
        self.k, self.first = k, first  # first: a score that k others are known to reach
        self.kth = np.full(n, NONE)
        self.held = [tuple(np.zeros(0, np.int64) for _ in range(3))]  # (query, id, score), settled ones first
        self.settled = self.waiting = 0

    def bar(self) -> np.ndarray:
        return np.maximum(self.kth, self.first)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, ids, score))
        self.waiting += len(q)
        if self.waiting >= max(WAIT, self.settled):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < self.k
        full = rank == self.k - 1
        self.kth[q[full]] = score[full]
        self.held = [(q[keep], ids[keep], score[keep])]
        self.settled, self.waiting = int(keep.sum()), 0
        return self.held[0]


def _products(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of q[i] and v[j], some pairs at a time."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 18):
        out[s : s + (1 << 18)] = np.einsum("ij,ij->i", q[i[s : s + (1 << 18)]], v[j[s : s + (1 << 18)]])
    return out


def _all_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    if np.sqrt((qf**2).sum(axis=1).max(initial=0.0)) * np.sqrt((vf**2).sum(axis=1).max(initial=0.0)) < EXACT:
        return (qf @ vf.T).astype(np.int64)
    return q @ v.T


def _search(shared, k: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, rot, first = shared.value
        if not len(qid):
            return
        qf = q.astype(np.float64)
        qr = qf @ rot
        q_lead, q_rest, q_len = qr[:, :LEAD], np.sqrt((qr[:, LEAD:] ** 2).sum(axis=1)), np.sqrt((qr**2).sum(axis=1))
        best = _Best(len(qid), k, first)
        for batch in batches:
            ids, x = batch["id"].to_numpy(), _matrix(batch["v"])
            for a in range(0, len(ids), STEP):
                v, vid = x[a : a + STEP], ids[a : a + STEP]
                vf = v.astype(np.float64)
                vr = vf @ rot
                v_len, v_rest = np.sqrt((vr**2).sum(axis=1)), np.sqrt((vr[:, LEAD:] ** 2).sum(axis=1))
                longest = v_len.max(initial=0.0)
                bar = best.bar()
                low = bar - 1e-9 * (1 + q_len * longest)
                live = np.flatnonzero(q_len * longest >= low)
                if not len(live):
                    continue
                bound = q_lead[live] @ vr[:, :LEAD].T
                bound += np.outer(q_rest[live], v_rest)
                hit = bound >= low[live][:, None]
                hit &= qid[live][:, None] != vid
                if np.count_nonzero(hit) * DENSE >= hit.size and q_len.max() * longest < EXACT:
                    score = np.matmul(qf[live], vf.T, out=bound)
                    hit &= score >= bar[live][:, None]
                    i, j = np.nonzero(hit)
                    best.add(live[i], vid[j], score[i, j].astype(np.int64))
                else:
                    i, j = np.nonzero(hit)
                    score = _products(q, v, live[i], j)
                    keep = score >= bar[live[i]]
                    best.add(live[i[keep]], vid[j[keep]], score[keep])
        i, ids, score = best.settle()
        for s in range(0, len(i), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in (qid[i], ids, score)], names=["query_id", "vec_id", "score"])

    return rows


def quantized(df: DataFrame, id_col: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v array<long>) of floor(scale * x), without rows whose id or vector is null or holds a null or non-finite number."""
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vector) > 0)
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k highest integer inner products of each query (rows whose id is divisible by ``every``) against all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows give fewer results.  Vectors
    that are null, empty, or hold null or non-finite numbers take no part.  Shorter vectors count as padded with zeros.
    Rows that share an id are never each other's results; as candidates they are judged one by one.
    """
    spark = df.sparkSession
    store.ship(spark)
    v = quantized(df, id_col, vector, scale)
    dim = v.agg(F.max(F.size("v"))).first()[0]
    out = "query_id long, vec_id long, score long"
    if dim is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    v = v.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    v = v.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * x).cast("double")))
    v = store.materialize(v, "vectors")
    sums = v.select("v").mapInArrow(_moments, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s"))
    gram = np.zeros(dim * dim)
    for r in sums.collect():  # dim * dim rows
        gram[r.pos] = r.s
    rot = np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = v.repartitionByRange(n, F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc()).select("id", "v")
    seed = v.orderBy(F.col("norm").desc(), "id").limit(SEED).collect()
    seed_id, seed_v = np.array([r.id for r in seed]), np.array([r.v for r in seed], np.int64).reshape(len(seed), dim)
    queries = v.where(F.col("id") % every == 0)
    count = queries.count()
    parts = max(1, -(-count // CHUNK))
    found = None
    for c in range(parts):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == c).select("id", "v").distinct() if parts > 1 else queries.select("id", "v").distinct()
        rows = own.collect()  # about CHUNK rows
        qid, q = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.int64).reshape(len(rows), dim)
        s = _all_products(q, seed_v)
        s[qid[:, None] == seed_id[None, :]] = NONE
        first = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(qid), NONE)
        part = dealt.mapInArrow(_search(spark.sparkContext.broadcast((qid, q, rot, first)), k), out)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
