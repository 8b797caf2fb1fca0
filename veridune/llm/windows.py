"""Cross-document repeats of fixed-length windows: the distributed frame shared by the two span-removing operators.

1. Texts become blocks (store.py).  Each block's windows fall into runs with one anchor each (grams.py).
2. Anchors, 32 bits each beside their bucket, are dealt to buckets.  A bucket answers each block with one bit an anchor:
   does the anchor also occur in another document?  Windows of other anchors occur in one document only.
3. The remaining runs travel as fragments of text to their bucket; inside a block, equal fragments are combined first and
   all but those of the least document are marked there and then, so a hot passage costs a row a block.
4. In its bucket, a *resolver* (suffix array or suffix automaton) finds for each distinct fragment the least document of
   each of its windows.  Windows that start in a lesser document are marked.
5. Marks return to their blocks, and whole texts are cut.

The number of buckets follows the bytes of text, so a bucket stays small at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, store

BUCKET_BYTES = 8 << 20
MARKS, FRAGMENTS = 0, 1


def _npz(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed record."""
    t = pa.table({k: pa.array([v.tobytes()], pa.large_binary()) for k, v in arrays.items()})
    return store.dump(t)


def _unnpz(blob: bytes, **kinds) -> dict[str, np.ndarray]:
    t = store.load(blob)
    return {k: np.frombuffer(t[k][0].as_buffer(), d) for k, d in kinds.items()}


class Bytes:
    """Windows over the UTF-8 bytes of a text; shard: units resolved at once."""

    def __init__(self, length: int = 50, k: int = 24, shard: int = 1 << 20):
        self.length, self.k, self.shard = length, k, shard

    def units(self, buf, off):
        """(value function, unit offsets of the texts, first byte of each unit or None, end byte of each unit or None)"""
        return (lambda a, b: grams.byte_values(buf[a:b])), off, None, None


class Words:
    """Windows over words [^\\x20\\x09-\\x0D]+; shard: units resolved at once."""

    def __init__(self, length: int = 13, k: int = 5, shard: int = 20_000):
        self.length, self.k, self.shard = length, k, shard

    def units(self, buf, off):
        s, e, w = grams.words_of(buf, off)
        h = grams.word_hashes(buf, s, e)
        return (lambda a, b: h[a:b]), w, s, e


def _runs(table: pa.Table, text: str, id_col: str, unit, n_buckets: int):
    buf, off = store.texts_of(table, text)
    ids = store.ids_of(table, id_col)
    values, uoff, us, ue = unit.units(buf, off)
    seq, first, count, anchor = grams.window_runs(values, uoff, unit.length, unit.k)
    bucket = ((anchor >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    key = (bucket << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))
    return buf, ids, us, ue, seq, first, count, key


def _anchor_rows(text: str, id_col: str, unit, n_buckets: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                _, ids, _, _, seq, _, _, key = _runs(store.load(payload.as_buffer()), text, id_col, unit, n_buckets)
                if not len(key):
                    continue
                order = np.lexsort((ids[seq], key))
                key, doc = key[order], ids[seq][order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(new)
                several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)
                key = key[at]
                bucket = (key >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                ends = np.append(cut[1:], len(key))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut], pa.int64()),
                        pa.array(np.full(len(cut), block), pa.int64()),
                        pa.array([low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "several"],
                )

    return rows


def _shared(table: pa.Table) -> pa.Table:
    """One bit an anchor: does it occur in two documents at least?"""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"]]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k)).astype(bool) for x, k in zip(table["several"], keys, strict=True)]
    every = np.concatenate(keys)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    hit = counts > 1
    np.logical_or.at(hit, inverse[np.concatenate(several)], True)
    bits, at, out = hit[inverse], 0, []
    for k in keys:
        out.append(np.packbits(bits[at : at + len(k)]).tobytes())
        at += len(k)
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(out, pa.binary())})


def _fragment_rows(text: str, id_col: str, unit, n_buckets: int):
    span = unit.length - 1

    def of(block: int, payload, bits) -> Iterator[tuple[int, int, int, bytes]]:
        buf, ids, us, ue, seq, first, count, key = _runs(store.load(payload.as_buffer()), text, id_col, unit, n_buckets)
        uniq = np.unique(key)
        shared = np.zeros(len(uniq), bool)
        ub = (uniq >> np.uint64(32)).astype(np.int64)
        for x in bits:
            a, b = np.searchsorted(ub, [x["bucket"], x["bucket"] + 1])
            shared[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        keep = np.flatnonzero(shared[np.searchsorted(uniq, key)])
        keep = keep[np.lexsort((first[keep], ids[seq[keep]]))]  # the least document first
        seq, first, count, key = seq[keep], first[keep], count[keep], key[keep]
        if us is not None:
            buf, us, ue = grams.joined_words(buf, us, ue)
        lo, hi = (first, first + count + span) if us is None else (us[first], ue[first + count + span - 1])
        # equal fragments of a greater document are marked here; hashes propose, bytes decide
        code = grams.span_hashes(buf, lo, hi)
        order = np.argsort(code, kind="stable")
        again = np.zeros(len(code), bool)
        again[order[1:]] = code[order[1:]] == code[order[:-1]]
        again[order[:-1]] |= code[order[1:]] == code[order[:-1]]
        local = np.zeros(len(code), bool)
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(again).tolist():
            local[i] = seen.setdefault(buf[lo[i] : hi[i]].tobytes(), int(ids[seq[i]])) < ids[seq[i]]
        x = np.flatnonzero(local)
        if len(x):
            yield -1, block, MARKS, _npz(seq=seq[x].astype(np.int32), first=first[x].astype(np.int64), count=count[x].astype(np.int32))
        x = np.flatnonzero(~local)
        if not len(x):
            return
        x = x[np.argsort(key[x] >> np.uint64(32), kind="stable")]
        bucket = (key[x] >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(x)), strict=True):
            i = x[a:b]
            yield (
                int(bucket[a]),
                block,
                FRAGMENTS,
                _npz(
                    doc=ids[seq[i]].astype(np.int64), seq=seq[i].astype(np.int32), first=first[i].astype(np.int64), count=count[i].astype(np.int32),
                    size=(hi[i] - lo[i]).astype(np.int64), text=grams.gather(buf, lo[i], hi[i]), low=(key[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                ),
            )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                got = list(of(block, batch["payload"][i], batch["bits"][i].as_py() or ()))
                if got:
                    b, k, kind, blob = zip(*got, strict=True)
                    b = [n_buckets + (block * 0x9E3779B97F4A7C15 >> 32) % n_buckets if x < 0 else x for x in b]  # marks only pass through, spread as wide as fragments
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "block", "kind", "blob"])

    return rows


def _by_shard(contents: list[bytes], least: np.ndarray, windows: np.ndarray, anchors: np.ndarray, unit, resolver: Callable) -> np.ndarray:
    """The least document of each window; the resolver sees one shard of whole anchors at a time, to bound memory."""
    out = np.empty(int(windows.sum()), np.int64)
    start = np.cumsum(windows) - windows
    order = np.argsort(anchors, kind="stable")
    units = np.cumsum(windows[order] + unit.length - 1)
    last = np.append(anchors[order][1:] != anchors[order][:-1], True)
    at = 0
    while at < len(order):
        base = units[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(units, base + unit.shard, "right")))
        to += int(np.argmax(last[to - 1 :]))
        i = order[at:to]
        got = resolver([contents[j] for j in i], least[i], windows[i], unit.length)
        n = windows[i]
        out[np.repeat(start[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = got
        at = to
    return out


def _resolved(unit, resolver: Callable):
    kinds = {"doc": np.int64, "seq": np.int32, "first": np.int64, "count": np.int32, "size": np.int64, "text": np.uint8, "low": np.uint32}

    def resolve(table: pa.Table) -> pa.Table:
        out_block, out_blob = [], []
        rows = []
        for block, kind, blob in zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["blob"], strict=True):
            if kind == MARKS:
                out_block.append(block)
                out_blob.append(blob.as_py())
            else:
                rows.append((block, _unnpz(blob.as_buffer(), **kinds)))
        if rows:
            # equal fragments of several blocks are one; the least document stands for it
            index: dict[bytes, int] = {}
            contents, least, windows, low = [], [], [], []
            of = []
            for _, r in rows:
                raw, at, which = r["text"].tobytes(), 0, np.empty(len(r["doc"]), np.int64)
                for j, (d, n, c, h) in enumerate(zip(r["doc"].tolist(), r["size"].tolist(), r["count"].tolist(), r["low"].tolist(), strict=True)):
                    part = raw[at : at + n]
                    at += n
                    k = index.setdefault(part, len(contents))
                    if k == len(contents):
                        contents.append(part)
                        least.append(d)
                        windows.append(c)
                        low.append(h)
                    elif d < least[k]:
                        least[k] = d
                    which[j] = k
                of.append(which)
            least, windows = np.array(least, np.int64), np.array(windows, np.int64)
            start = np.cumsum(windows) - windows
            found = _by_shard(contents, least, windows, np.array(low, np.uint32), unit, resolver)
            earlier = np.concatenate([[0], np.cumsum(found < np.repeat(least, windows))])
            for (block, r), k in zip(rows, of, strict=True):
                whole = r["doc"] > least[k]
                some = np.flatnonzero(~whole & (earlier[start[k] + windows[k]] > earlier[start[k]]))
                seq, first, count = [r["seq"][whole]], [r["first"][whole]], [r["count"][whole]]
                for j in some.tolist():
                    f, n = start[k[j]], windows[k[j]]
                    hit = np.concatenate([[False], found[f : f + n] < r["doc"][j], [False]])
                    edge = np.flatnonzero(hit[1:] != hit[:-1])
                    seq.append(np.full(len(edge) // 2, r["seq"][j], np.int32))
                    first.append(r["first"][j] + edge[::2])
                    count.append((edge[1::2] - edge[::2]).astype(np.int32))
                if sum(map(len, seq)):
                    out_block.append(block)
                    out_blob.append(_npz(seq=np.concatenate(seq).astype(np.int32), first=np.concatenate(first).astype(np.int64), count=np.concatenate(count).astype(np.int32)))
        return pa.table({"block": pa.array(out_block, pa.int64()), "marks": pa.array(out_blob, pa.binary())})

    return resolve


def _cut(text: str, id_col: str, unit, id_type: pa.DataType):
    """Applies marks: id, units, removed units, byte spans removed, kept bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, marks in zip(batch["payload"], batch["marks"], strict=True):
                t = store.load(payload.as_buffer())
                buf, off = store.texts_of(t, text)
                ids = store.ids_of(t, id_col)
                _, uoff, us, ue = unit.units(buf, off) if not isinstance(unit, Words) else (None, *_word_units(buf, off))
                delta = np.zeros(int(uoff[-1]) + 1, np.int32)
                for m in marks.as_py() or ():
                    r = _unnpz(m, seq=np.int32, first=np.int64, count=np.int32)
                    np.add.at(delta, r["first"], 1)
                    np.add.at(delta, r["first"] + r["count"] + unit.length - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                raw = buf.tobytes()
                out = {"n_units": [], "n_removed": [], "spans": [], "kept": []}
                for i in range(len(ids)):
                    a, b = int(uoff[i]), int(uoff[i + 1])
                    g = gone[a:b]
                    n = int(g.sum())
                    if us is None:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
                        spans = edge.reshape(-1, 2)
                        kept = raw[a:b] if not n else buf[a:b][~g].tobytes()
                    else:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]))).reshape(-1, 2)
                        spans = np.column_stack([us[a + edge[:, 0]], ue[a + edge[:, 1] - 1]]) - off[i] if len(edge) else edge
                        kept = b" ".join(raw[int(off[i]) : int(off[i + 1])].split()) if not n else b" ".join(raw[s:e] for s, e in zip(us[a:b][~g].tolist(), ue[a:b][~g].tolist(), strict=True))
                    out["n_units"].append(b - a)
                    out["n_removed"].append(n)
                    out["spans"].append([{"start": int(s), "end": int(e)} for s, e in spans])
                    out["kept"].append(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        store.id_array(ids).cast(id_type),
                        pa.array(out["n_units"], pa.int64()),
                        pa.array(out["n_removed"], pa.int64()),
                        pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(out["kept"], pa.binary()),
                    ],
                    names=[id_col, "n_units", "n_removed", "spans", "kept"],
                )

    return rows


def _word_units(buf, off):
    s, e, w = grams.words_of(buf, off)
    return w, s, e


def remove_repeats(docs: DataFrame, unit, resolver: Callable, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts every unit covered by a window that also starts in a document of smaller id.

    resolver(contents, least, windows, length) gets distinct fragments, their least documents and their numbers of
    windows, and gives the least document of every window, fragment after fragment.

    Returns id_col, n_units, n_removed, spans (byte positions, end exclusive), kept (bytes).  A null text is empty; a null
    id counts as greater than every other id; rows that share an id are one document in comparisons and stay one row each.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    blocks = store.to_blocks(docs, text)
    n = max(64, -(-store.total_bytes(blocks) // BUCKET_BYTES))
    anchors = blocks.select("block", "payload").mapInArrow(_anchor_rows(text, id_col, unit, n), "bucket long, block long, keys binary, several binary")
    bits = anchors.groupBy("bucket").applyInArrow(_shared, "block long, bucket long, bits binary")
    bits = store.materialize(bits, "bits").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    fragments = blocks.select("block", "payload").join(bits, "block", "left").mapInArrow(_fragment_rows(text, id_col, unit, n), "bucket long, block long, kind int, blob binary")
    marks = fragments.groupBy("bucket").applyInArrow(_resolved(unit, resolver), "block long, marks binary")
    marks = store.materialize(marks, "marks", "uncompressed").groupBy("block").agg(F.collect_list("marks").alias("marks"))
    cut = blocks.select("block", "payload").join(marks, "block", "left")
    schema = f"`{id_col}` long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return cut.mapInArrow(_cut(text, id_col, unit, pa.int64()), schema)
