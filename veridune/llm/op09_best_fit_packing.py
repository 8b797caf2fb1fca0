"""Packing documents into sequences by the configuration linear program over the length histogram.

The histogram has at most ``size`` lengths.  Multiplicative weights price each length by how much of it is still
uncovered; pricing a configuration is a knapsack, solved exactly by dynamic programming over the capacity; the best
configuration is used a whole number of times (rounded to what is there), and weights move.  What rounding leaves over is
packed best-fit decreasing by counts.  The plan, at most a few thousand configurations whatever the number of documents, is sent to the tasks, where ranks of pieces within their
length (a count per block and length, then running sums) say which configuration, sequence and offset each takes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .units import default_path, encoder

ROUNDS = 60


def knapsack(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth of a multiset of lengths for each capacity, and a length it takes there (0: that of one less)."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    value = np.where(price > 0, price, -np.inf)[1:]
    back = np.zeros(size + 1)  # best, read backwards
    for c in range(1, size + 1):
        v = back[size + 1 - c :] + value[:c]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], took[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
        back[size - c] = best[c]
    return best, took


def trace(took: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        n = int(took[c])
        if n:
            out.append(n)
        c -= n or 1
    return out


def _best_fit(left: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts of lengths: bins with one content are one entry."""
    rooms: dict[int, list[list]] = {}  # room -> [[contents, bins]]
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            fits = [r for r in rooms if r >= n]
            if not fits:
                per = size // n
                bins, rest = divmod(todo, per)
                if bins:
                    rooms.setdefault(size - per * n, []).append([((n, per),), bins])
                if rest:
                    rooms.setdefault(size - rest * n, []).append([((n, rest),), 1])
                break
            r = min(fits)
            what, bins = rooms[r].pop()
            if not rooms[r]:
                del rooms[r]
            per = min(r // n, todo)
            use = min(bins, todo // per)
            if use < bins:
                rooms.setdefault(r, []).append([what, bins - use])
            rooms.setdefault(r - per * n, []).append([(*what, (n, per)), use])
            todo -= use * per
    return [(bins, list(what)) for groups in rooms.values() for what, bins in groups]


def plan(histogram: dict[int, int], size: int, rounds: int = ROUNDS, near: float = 0.02, rate: float = 30.0) -> tuple[list[tuple[int, list[tuple[int, int]]]], float]:
    """[(times, [(length, count), ...]), ...] covering the histogram exactly, and a lower bound of the sequences needed.

    Each round prices all configurations by one dynamic program and takes those within ``near`` of the best that start
    with each length; a round's share of the volume is spread over them.  Weights fall with coverage at ``rate``.
    Where plain best-fit on the whole histogram needs fewer sequences than the rounded program, its sequences are taken.
    """
    total = np.zeros(size + 1, np.int64)
    for n, c in histogram.items():
        total[n] += c
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if total[size]:
        out.append((int(total[size]), [(size, 1)]))
    full, left = float(total[size]), total.copy()
    left[size] = 0
    plain = _best_fit(left.copy(), size)
    kinds = np.flatnonzero(left)
    bound = float((np.arange(size + 1) * left).sum()) / size
    need = bound
    amount: dict[tuple, float] = {}
    cover = np.zeros(size + 1)
    for _ in range(rounds if len(kinds) else 0):
        weight = np.exp(-rate * np.minimum(cover, 3.0))
        price = np.zeros(size + 1)
        price[kinds] = kinds * weight[kinds]
        best, took = knapsack(price, size)
        bound = max(bound, float((left * price).sum()) / best[size])  # prices over the best worth are a feasible dual
        worth = price[kinds] + best[size - kinds]
        heads = kinds[worth >= (1 - near) * best[size]]
        shares = left[heads] * weight[heads]
        step = need / rounds * shares / shares.sum()
        got = np.zeros(size + 1)
        for n, x in zip(heads.tolist(), step.tolist(), strict=True):
            items = tuple(sorted([n, *trace(took, size - n)]))
            amount[items] = amount.get(items, 0.0) + x
            for k in items:
                got[k] += x
        cover[kinds] += got[kinds] / left[kinds]
        need = max(need, bound)
    whole: list[tuple[int, list[tuple[int, int]]]] = []
    # whole multiples, nothing covered twice; fullest configurations first
    for items, x in sorted(amount.items(), key=lambda e: (-sum(e[0]), e[0])):
        k, n = np.unique(items, return_counts=True)
        times = min(int(x / max(1.0, cover[k].max())), int((left[k] // n).min()))
        if times:
            left[k] -= times * n
            whole.append((times, list(zip(k.tolist(), n.tolist(), strict=True))))
    whole += _best_fit(left, size)
    return out + min(whole, plain, key=lambda c: sum(times for times, _ in c)), bound + full


def _pieces(path: str | None, size: int, end: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path or default_path("word_bpe_49k.json"), "words")
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n = enc.ids(batch["text"], end)
            raw, docs, a = memoryview(ids.view(np.uint8)), batch["id"].to_numpy(), 0
            per = -(-n // size)
            to = np.cumsum(per)
            row = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(row)) - (to - per)[row]
            start = piece * size
            length = np.minimum(n[row] - start, size)
            ends = 4 * np.cumsum(length)  # pieces stand one after another, as the ids do
            crc = np.array([zlib.crc32(raw[x:y]) for x, y in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)], np.int64)
            for b in to[np.minimum(np.arange(255, len(n) + 255, 256), len(n) - 1)].tolist():
                t = pa.table({"doc": pa.array(docs[row[a:b]]), "piece": pa.array(piece[a:b].astype(np.int32)), "start": pa.array(start[a:b]), "length": pa.array(length[a:b].astype(np.int32)), "crc": pa.array(crc[a:b])})
                k, c = np.unique(length[a:b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq]), pa.array([k.tolist()], pa.list_(pa.int64())), pa.array([c.tolist()], pa.list_(pa.int64())), pa.array([store.dump(t)], pa.binary())], names=["block", "lengths", "counts", "payload"])
                seq, a = seq + 1, b

    return rows


def _place(where):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            for payload, ranks in zip(batch["payload"], batch["ranks"].to_pylist(), strict=True):
                t = store.load(payload.as_buffer())
                n = t["length"].to_numpy().astype(np.int64)
                sid, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                first = {r["length"]: r["first"] for r in ranks}
                for length in np.unique(n).tolist():
                    i = np.flatnonzero(n == length)
                    r = first[length] + np.arange(len(i))
                    begin, base, per, at = table[length]
                    k = np.searchsorted(begin, r, "right") - 1
                    q = r - begin[k]
                    sid[i] = base[k] + q // per[k]
                    off[i] = at[k] + (q % per[k]) * length
                doc = t["doc"].to_numpy()
                yield pa.RecordBatch.from_arrays([store.id_array(doc), t["piece"].combine_chunks(), t["start"].combine_chunks(), pa.array(n), t["crc"].combine_chunks(), pa.array(sid), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 2048, end: int = 0, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Packs whole documents into sequences of at most ``size`` tokens.

    A document is its ids by the tokenizer file ``tokenizer`` (default word_bpe_49k.json) and the id ``end``; longer ones
    are cut into pieces of ``size``, the last may be shorter.  Returns a row a piece: id_col, piece int, start, length,
    ids_crc32, sequence_id, offset.  Null or empty text: the end id alone.  Rows with one id (or a null id) are packed each.
    Empty table: empty result.
    """
    spark = docs.sparkSession
    store.ship(spark)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(store.NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    blocks = store.materialize(src.mapInArrow(_pieces(tokenizer, size, end), "block long, lengths array<long>, counts array<long>, payload binary"), "pieces", "uncompressed")
    counts = blocks.select("block", F.explode(F.arrays_zip("lengths", "counts")).alias("x")).select("block", F.col("x.lengths").alias("length"), F.col("x.counts").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    configurations, _ = plan(histogram, size, rounds)
    table: dict[int, list[list[int]]] = {}
    done: dict[int, int] = {}
    base = 0
    for times, items in configurations:
        at = 0
        for length, n in items:
            row = table.setdefault(length, [[], [], [], []])
            for col, v in zip(row, (done.get(length, 0), base, n, at), strict=True):
                col.append(v)
            done[length] = done.get(length, 0) + times * n
            at += length * n
        base += times
    where = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in v) for k, v in table.items()})  # a few thousand configurations at most
    # prefix sums within a partition's blocks and over partitions, so that a length that every block holds isn't one task's
    counts = counts.withColumn("part", F.shiftright("block", 32))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("length", "part").agg(F.sum("n").alias("all")).select("length", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("length", "part").orderBy("block")) - F.col("n")
    ranked = counts.withColumn("within", within).join(parts, ["length", "part"]).withColumn("first", F.col("base") + F.col("within"))
    ranks = ranked.groupBy("block").agg(F.collect_list(F.struct("length", "first")).alias("ranks"))
    out = blocks.select("block", "payload").join(ranks, "block").mapInArrow(_place(where), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
