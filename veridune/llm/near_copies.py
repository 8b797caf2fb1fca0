"""Near copies by Jaccard similarity of word shingles, found whole by prefix filtering and verified exactly.

Texts are sets of hashed shingles in one global order: shingles frequent in a sample of rows last, hashes ascending
otherwise (the order decides cost, never the result).  Two sets of similarity s or more share k shingles or more among their
first n - ceil(s n) + k, so pairs meet at shingles of both prefixes, k of them at least, where k is a fortieth of the
smaller set and one more; sizes and positions rule more pairs out, then parities of
hash buckets, which differ at most once for each shingle that only one set holds, and the texts decide.  Links of the
caller's own (fingerprints on a grid) are verified first; then neighbours and the first of each shingle's sets, then sets
up to eight places apart, which joins large groups in linear time; at last every pair of sets not yet in one component.

Pairs are looked at in cells.  A set's home is its first prefix shingle, which likely copies share, in chunks of about
``CHUNK`` sets; a cell is two homes, and what is needed of a set goes to a cell once, not once a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import connected_components
from .grams import majority_bits

SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 100_000  # late from about 48 rows on, so that a key's pairs stay few at any size
LEAST_PARITIES = 128
CHUNK = 128
CELL_SCHEMA = "cell long, a long, b long"
PAIR_SCHEMA = "a long, b long"
BROADCAST_ROWS = 1_000_000  # of two longs at most: 16 MB; beyond that, joins are dealt out by key


def shingles(raw: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words, of the whole text if it has fewer; A-Z are lower-cased."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size) - 1
    n = max(1, len(w) - words + 1)
    last = ends[words - 1 :].tolist() if len(w) >= words else [len(joined)]
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([hash64(joined[a:b], 42) for a, b in zip((ends + 1 - size)[:n].tolist(), last, strict=True)], np.uint64, n))


def _all(words: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"].cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py() or b"", words).view(np.int64))], names=["key"])

    return rows


def _parities(h: np.ndarray) -> bytes:
    """A bit for each bucket that holds an odd number of hashes; a bucket a hash or more: sets of similarity 0.7 already differ in too many, and
    these bits travel to every cell that looks at the set."""
    buckets = max(LEAST_PARITIES, 1 << len(h).bit_length())
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets).astype(np.uint8) & 1).tobytes()


def _meetings(n):
    """How many shingles of both prefixes two similar sets share, of which the smaller has n."""
    return 1 + n // 40


def _sets(shared, words: int, similarity: float):
    """node names a set by a hash of all its shingles, fp is its fingerprint; keys are its prefix."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            node, n, keys, odd, fp = [], [], [], [], []
            for t in batch["text"].cast(pa.binary()):
                h = shingles(t.as_py() or b"", words)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                n.append(len(h))
                fp.append(majority_bits(h))
                odd.append(_parities(h))
                if len(common) and len(h):
                    late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    h = np.concatenate([h[~late], h[late]])
                keys.append(h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + _meetings(len(h)) if len(h) else 0])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), lists, pa.array(odd, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["row", "id", "node", "n", "keys", "odd", "fp"])

    return rows


def _by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole keys of rows that arrive sorted by key."""
    held: list[dict[str, np.ndarray]] = []
    join = lambda parts: {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    for batch in batches:
        x = {c: batch[c].to_numpy() for c in batch.schema.names}
        if not len(x["key"]):
            continue
        cut = int(np.searchsorted(x["key"], x["key"][-1], "left"))
        if cut or (held and held[-1]["key"][-1] != x["key"][-1]):
            yield join([*held, {c: v[:cut] for c, v in x.items()}])
            held = []
        held.append({c: v[cut:] for c, v in x.items()})
    if held:
        yield join(held)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key and node, of keys that two sets hold; each set once a key."""
    for x in _by_key(batches):
        key, node = x["key"], x["node"]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        i = np.flatnonzero(first)
        same = key[i][1:] == key[i][:-1]
        i = i[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(i) else i
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(x[c][i]) for c in ("key", "node", "n", "pos")], names=["key", "node", "n", "pos"])


def _candidates(similarity: float, steps: int | None):
    """Pairs of a key's sets that sizes and positions allow, of different roots and up to so many places apart (None: any), and the
    first beside each where they aren't all; rows sorted by key, size and node."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_key(batches):
            key, node, n, pos, root = (x[c] for c in ("key", "node", "n", "pos", "root"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(key)))
            start, live = np.repeat(begin, size), np.arange(len(key))

            def out(i, j):
                most = 1 + np.minimum(n[i] - 1 - pos[i], n[j] - 1 - pos[j]) + np.minimum(pos[i], pos[j])
                ok = (root[i] != root[j]) & (n[i] >= similarity * n[j] - 1e-9) & (most >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
                a, b = node[i[ok]], node[j[ok]]
                if len(a):
                    need = _meetings(np.minimum(n[i[ok]], n[j[ok]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])

            if steps:
                yield from out(start, live)
            step = 1
            while len(live) and step <= (steps or len(key)):
                live = live[live + step < len(key)]
                live = live[key[live] == key[live + step]]
                live = live[n[live] >= similarity * n[live + step] - 1e-9]
                yield from out(live, live + step)
                step += 1

    return rows


def _by_cell(decide: Callable):
    """(cell, a, b) of the pairs that decide(n, data, i, j) keeps; rows arrive sorted by cell, a cell's sets (b null) before its pairs."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, pairs = None, {}, []

        def out():
            if not pairs:
                return
            at = {node: i for i, node in enumerate(sets)}
            i, j = (np.fromiter((at[p[k]] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
            keep = decide(np.array([x[0] for x in sets.values()], np.int64), [x[1] for x in sets.values()], i, j)
            kept = [p for p, ok in zip(pairs, keep.tolist(), strict=True) if ok]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(kept), pa.int64()), pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64())], names=["cell", "a", "b"])

        for batch in batches:
            for c, a, b, n, data in zip(batch["cell"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), batch["n"].to_pylist(), batch["data"], strict=True):
                if c != cell:
                    yield from out()
                    cell, sets, pairs = c, {}, []
                if b is None:
                    sets[a] = (n, data.as_py())
                else:
                    pairs.append((a, b))
        yield from out()

    return rows


def _possible(similarity: float) -> Callable:
    """Pairs whose parities differ in no more buckets than sets of that similarity can."""

    def decide(n, data, i, j):
        size = np.array(list(map(len, data)), np.int64)
        least, keep = np.minimum(size[i], size[j]), np.zeros(len(i), bool)
        for m in np.unique(least).tolist():
            pairs = np.flatnonzero(least == m)
            used, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
            folded = []
            for k in used.tolist():
                x = np.frombuffer(data[k], np.uint64)
                while 8 * len(x) > m:  # as many buckets as the other has: halves lie on each other
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                folded.append(x)
            x, a, b = np.stack(folded), at[: len(pairs)], at[len(pairs) :]
            for c in range(0, len(pairs), 4096):
                part = pairs[c : c + 4096]
                differ = np.bitwise_count(x[a[c : c + 4096]] ^ x[b[c : c + 4096]]).sum(axis=1, dtype=np.int64)
                keep[part] = differ <= (1 - similarity) / (1 + similarity) * (n[i[part]] + n[j[part]]) + 1e-9
        return keep

    return decide


def _few(df: DataFrame) -> DataFrame:
    """df, a written table of a few longs a row, broadcast if its rows are counted few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _zip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([pack.compress(t.as_py() or b"") for t in batch["text"].cast(pa.binary())], pa.binary())], names=["node", "text"])


def _verify(words: int, similarity: float) -> Callable:
    """Pairs whose texts' sets are that similar."""

    def decide(n, data, i, j):
        unpack = zstandard.ZstdDecompressor().decompress
        held = [shingles(unpack(x), words) for x in data]
        both = np.array([len(np.intersect1d(held[p], held[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        size = np.array([len(h) for h in held], np.int64)
        return both >= similarity * (size[i] + size[j] - both) - 1e-9

    return decide


def keep_one(docs: DataFrame, first: Callable[[DataFrame], DataFrame], id_col: str, text: str, words: int, similarity: float) -> DataFrame:
    """docs with exactly one row of each group chained by similarity; first(sets(node, fp)) gives pairs (a, b) to look at at once."""
    spark = docs.sparkSession
    store.ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = store.materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    src = rows.select("row", F.coalesce(F.col("doc")[id_col].cast("long"), F.lit(store.NO_ID)).alias("id"), F.col("doc")[text].cast("string").alias("text"))
    sample = src.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_all(words), "key long").groupBy("key").count()
    common = sample.where(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "key").limit(MOST_FREQUENT).collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in common], np.int64).view(np.uint64)))
    sets = store.materialize(src.mapInArrow(_sets(common, words, similarity), "row long, id long, node long, n int, keys array<long>, odd binary, fp long"), "sets")
    posts = sets.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", "pos")
    shared = store.materialize(posts.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, n int, pos int"), "shared")
    slim = store.materialize(sets.select("row", "id", "node", "n", "odd", "fp", F.get("keys", F.lit(0)).alias("home")), "slim-sets")
    store.remove(spark, sets._veridune_path)
    sets = slim
    held = store.materialize(shared.select("node").distinct(), "shared-nodes")
    one = sets.select("node", "row").join(_few(held), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    one = store.materialize(one, "shared-rows")
    one = store.materialize(sets.select("row", "n", "odd", "fp", "home").join(_few(one), "row").select("node", "row", "n", "odd", "fp", "home"), "shared-sets")
    large = store.materialize(one.groupBy("home").count().where(F.col("count") > CHUNK), "homes")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("count", F.lit(1)) / CHUNK))
    homes = store.materialize(one.select("node", "home").join(_few(large), "home", "left").select("node", F.xxhash64("home", chunk).alias("home")), "homes")

    def looked_at(pairs: DataFrame, data: DataFrame, decide: Callable, name: str) -> DataFrame:
        """The written pairs(cell, a, b) that decide keeps, by data(node, n, data) sent to each cell that needs it."""
        need = pairs.select("cell", F.col("a").alias("node")).union(pairs.select("cell", "b")).distinct()
        if 2 * pairs.count() <= BROADCAST_ROWS // 2:  # a row and its place in the hash table
            need = F.broadcast(need)
        sent = data.join(need, "node").select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n", "data")
        asked = pairs.select("cell", "a", "b", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("data"))
        dealt = sent.unionByName(asked).repartition(parts, "cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
        return store.materialize(dealt.mapInArrow(_by_cell(decide), CELL_SCHEMA), name)

    def verified(pairs: DataFrame) -> DataFrame:
        home = lambda c: homes.select(F.col("node").alias(c), F.col("home").alias(f"h{c}"))
        cells = pairs.join(_few(home("a")), "a").join(_few(home("b")), "b").select(F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("cell"), "a", "b")
        cells = store.materialize(cells, "cells")
        likely = looked_at(cells, one.select("node", "n", F.col("odd").alias("data")), _possible(similarity), "likely")
        ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        rows_of = store.materialize(one.select("node", "row").join(ends, "node", "left_semi"), "ends")
        texts = store.materialize(src.select("row", "text").join(_few(rows_of), "row").select("node", "text").mapInArrow(_zip, "node long, text binary"), "texts")
        links = looked_at(likely, texts.select("node", F.lit(0).alias("n"), F.col("text").alias("data")), _verify(words, similarity), "links").select("a", "b")
        for t in (cells, likely, rows_of, texts):
            store.remove(spark, t._veridune_path)
        return links

    def candidates(roots: DataFrame, steps: int | None) -> DataFrame:
        rooted = shared.join(_few(roots), "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        met = rooted.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_candidates(similarity, steps), PAIR_SCHEMA + ", need long")
        met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need"))
        return (met if steps == 1 else met.where("met >= least(need, 2)") if steps else met.where("met >= need")).select("a", "b")

    seen = store.materialize(first(one.select("node", "fp")), "pairs")
    edges = verified(seen)
    for steps in (1, 8, None):
        roots = connected_components(edges)
        pairs = store.materialize(candidates(roots, steps).join(seen, ["a", "b"], "left_anti"), "pairs")
        edges, seen = edges.unionByName(verified(pairs)), seen.unionByName(pairs)
    roots = connected_components(edges)
    least = sets.select("row", "id", "node").join(_few(roots), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "row")).alias("least"))
    least = store.materialize(least.select(F.col("least.row").alias("row")), "least")
    for t in (sets, shared, one, large, homes):
        store.remove(spark, t._veridune_path)
    return rows.join(_few(least), "row", "left_semi").select("doc.*")
