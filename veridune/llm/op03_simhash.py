"""SimHash near-duplicates through a segment-popcount grid.

A fingerprint of 64 bits becomes 16 counts of set bits, one a segment of 4.  Flipping a bit moves one count by one, so the
Manhattan distance of the counts is at most the Hamming distance.  Links at two bits or fewer lie within Manhattan
distance two, and between two such points there is a grid point within one of each: every distinct fingerprint goes to
its own cell and the (at most 32) cells beside it, an equi-join on cells finds all candidates, and bits verify them.
Inside a cell candidates are compared with each other while few; crowded cells sort each fingerprint's 65 neighbours at
one bit or none, which finds the same links in linear time.  Only a spanning forest of the links leaves a task.

``keep_one`` is for copies by Jaccard similarity: links on the grid, checked on the texts, join most of them, and
near_copies.py completes them to all pairs of that similarity, which differ in about ten bits where they are least alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies, store
from .components import connected_components
from .grams import majority_bits

SEGMENTS, WIDTH = 16, 4
CROWDED = 48
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(raw: bytes, words: int = 3) -> int:
    w = raw.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends + 1 - size)[:n].tolist()
    last = ends[words - 1 :].tolist() if len(w) >= words else [len(joined)]
    hash64 = xxhash.xxh64_intdigest
    h = np.fromiter([hash64(joined[a:b], 42) for a, b in zip(starts, last, strict=True)], np.uint64, n)
    return majority_bits(h)


def _fingerprints(words: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or b"", words) for t in batch["text"].cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fp.view(np.int64), pa.int64())], names=["id", "fp"])

    return rows


def embed(fp: np.ndarray) -> np.ndarray:
    """Set bits of each segment, four bits a count."""
    x = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, doc = batch["fp"].to_numpy().view(np.uint64), batch["doc"].to_numpy()
        e = embed(fp)
        cells, rows = [e], [np.arange(len(fp))]
        for s in range(SEGMENTS):
            c = (e >> np.uint64(4 * s)) & np.uint64(15)
            for ok, step in ((c < WIDTH, np.uint64(1 << 4 * s)), (c > 0, np.uint64((1 << 64) - (1 << 4 * s)))):
                i = np.flatnonzero(ok)
                cells.append(e[i] + step)
                rows.append(i)
        i = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(fp[i].view(np.int64)), pa.array(doc[i])], names=["cell", "fp", "doc"])


def _links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs, enough to connect whatever is linked inside each cell; rows sorted by cell."""
    a, b = [], []
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    room = np.repeat(size, size)
    few = np.flatnonzero((room > 1) & (room <= CROWDED))
    for step in range(1, int(room[few].max()) if len(few) else 0):
        i = few[few + step < len(cell)]
        i = i[cell[i] == cell[i + step]]
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= 2]
        a.append(i)
        b.append(i + step)
    for at, n in zip(begin[size > CROWDED].tolist(), size[size > CROWDED].tolist(), strict=True):
        f = fp[at : at + n]
        near = np.concatenate([f, *(f ^ bit for bit in _BITS)])
        row = np.tile(np.arange(at, at + n), 65)
        order = np.argsort(near, kind="stable")
        same = np.flatnonzero(near[order[1:]] == near[order[:-1]])
        a.append(row[order[same]])
        b.append(row[order[same + 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star a component of the pairs (x, y): (node, least node)."""
    nodes, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = inverse[: len(x)], inverse[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    i = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[i], nodes[root[i]]


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell; a cell that goes on in the next batch waits for it."""
    held: list[tuple] = []

    def out(parts):
        cell, fp, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        i, j = _links(cell, fp.view(np.uint64))
        if len(i):
            n, r = _forest(doc[i], doc[j])
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(r)], names=["a", "b"])

    for batch in batches:
        cell, fp, doc = (batch[c].to_numpy() for c in ("cell", "fp", "doc"))
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut or (held and held[-1][0][-1] != cell[-1]):
            yield from out([*held, (cell[:cut], fp[:cut], doc[:cut])])
            held = []
        held.append((cell[cut:], fp[cut:], doc[cut:]))
    if held:
        yield from out(held)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Groups of documents whose fingerprints are chained by links at two differing bits or fewer.

    Returns id_col, fingerprint (16 hex digits), component_id (least id of the group), group_size (rows with the same
    fingerprint).  A-Z are lower-cased; a null or empty text has fingerprint zero and links like any other.  A null id
    counts as greater than every other and comes back null.  Rows with one id are joined through it only if fingerprints
    link.  Texts may have any length; further columns, of whatever names, are left out.  Empty table: empty result.
    """
    store.ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(store.NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    prints = store.materialize(docs.mapInArrow(_fingerprints(words), "id long, fp long"), "fingerprints")
    nodes = store.materialize(prints.groupBy("fp").agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("group_size")), "nodes")
    # nodes are named by their fingerprint: ids may repeat, fingerprints do not
    cells = nodes.select("fp", F.col("fp").alias("doc")).mapInArrow(_cells, "cell long, fp long, doc long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_edges, "a long, b long")
    roots = connected_components(edges)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", "group_size", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    least = store.materialize(least, "least")
    named = store.materialize(named.join(least, "root").select("fp", "component_id", "group_size"), "components")
    out = prints.join(named, "fp")
    back = lambda c: F.when(F.col(c) != store.NO_ID, F.col(c))
    return out.select(back("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("component_id").alias("component_id"), "group_size")


def grid_links(sets: DataFrame) -> DataFrame:
    """(a, b): each node of sets(node, fp) beside its fingerprint's least node, and a forest over linked fingerprints."""
    nodes = store.materialize(sets.groupBy("fp").agg(F.min("node").alias("doc")), "nodes")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select("fp", "doc").mapInArrow(_cells, "cell long, fp long, doc long")
    edges = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_edges, "a long, b long")
    same = sets.select("node", "fp").distinct().join(nodes, "fp").select(F.col("node").alias("a"), F.col("doc").alias("b"))
    return same.unionByName(edges).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns whatever their names, with exactly one row of each group chained by similarity: its least id's, null ids last.

    Rows are told apart by place, so repeated and null ids are rows like any other, and of equal ids any one row may stay.
    Texts without a word (null, empty, white space) are equal; texts may have any length.  Empty table: empty result.
    """
    return near_copies.keep_one(docs, grid_links, id_col, text, words, similarity)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
