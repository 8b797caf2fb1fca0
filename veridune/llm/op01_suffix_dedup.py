"""Suffix-array deduplication with a difference cover, one suffix bucket at a time.

Suffixes of the candidate fragments are sorted bucket by bucket (Spark deals buckets by anchor; inside a bucket they are
taken in slices by leading bytes).  A slice is sorted on 16 leading bytes; what is still tied is settled by the ranks of
the difference-cover sample, which are computed once a bucket, so no comparison ever runs along a long tie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows

PERIOD = 16
COVER = (0, 1, 2, 5, 8)  # every difference modulo 16 occurs between two members
_IN = np.zeros(PERIOD, bool)
_IN[list(COVER)] = True
_SHIFT = np.array([[next(s for s in range(PERIOD) if _IN[(a + s) % PERIOD] and _IN[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])
SLICE = 1 << 19


def _head(text: np.ndarray, at: np.ndarray, skip: int = 0) -> np.ndarray:
    """Eight bytes from each position, as big-endian numbers."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | text[at + (skip + j)]
    return out


def cover_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the sample suffixes on at least ``depth`` bytes, by prefix doubling; -1 off the sample.

    text holds n bytes and zero padding of depth + 2 * PERIOD bytes at least.
    """
    total = n + PERIOD
    at = np.flatnonzero(_IN[np.arange(total) % PERIOD])
    rank = np.full(len(text) + PERIOD, 0, np.int64)
    a, b = _head(text, at), _head(text, at, 8)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    r = np.cumsum(new)
    rank[at[order]] = r
    h = PERIOD
    while h < depth and (r[-1] if len(r) else 0) < len(at):
        key = (rank[at] << 31) | rank[np.minimum(at + h, len(rank) - 1)]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        r = np.cumsum(new)
        rank[at[order]] = r
        h *= 2
    return rank


def _settle(pos: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of suffixes that tie on PERIOD bytes within their groups (ascending): each is counted against every residue
    class at a shift that puts both in the sample."""
    wide = int(rank.max()) + 2
    cls = pos % PERIOD
    members = {}
    for c in range(PERIOD):
        i = np.flatnonzero(cls == c)
        if len(i):
            key = group[i] * wide + rank[pos[i] + _SHIFT[c, c]]
            members[c] = i[np.argsort(key, kind="stable")]
    place = np.zeros(len(pos), np.int64)
    for c, i in members.items():
        for d, j in members.items():
            s = _SHIFT[c, d]
            place[i] += np.searchsorted(group[j] * wide + rank[pos[j] + s], group[i] * wide + rank[pos[i] + s], "left")
    return np.argsort(place, kind="stable")


def sort_suffixes(text: np.ndarray, n: int, starts: np.ndarray, depth: int, rank: np.ndarray | None = None):
    """The suffixes at starts in order (at least by their first ``depth`` bytes), a slice of leading bytes at a time."""
    rank = cover_ranks(text, n, depth) if rank is None else rank
    head = _head(text, starts)
    cut = np.unique(np.sort(head)[SLICE::SLICE]) if len(starts) > SLICE else np.zeros(0, np.uint64)
    slot = np.searchsorted(cut, head, "right")
    for k in range(len(cut) + 1):
        take = np.flatnonzero(slot == k) if len(cut) else np.arange(len(starts))
        if not len(take):
            continue
        pos, a = starts[take], head[take]
        b = _head(text, pos, 8)
        order = np.lexsort((b, a))
        pos, a, b = pos[order], a[order], b[order]
        new = np.ones(len(pos), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new)
        size = np.bincount(group, minlength=group[-1] + 1)
        tied = np.flatnonzero(size[group] > 1)
        if len(tied):
            pos[tied] = pos[tied][_settle(pos[tied], group[tied], rank)]
        yield pos


def least_documents(contents: list[bytes], least: np.ndarray, windows_of: np.ndarray, length: int) -> np.ndarray:
    """For each window (a suffix start) the least document of all suffixes with the same first ``length`` bytes."""
    text = np.frombuffer(b"".join(contents) + bytes(length + 8 * PERIOD), np.uint8)
    n = len(text) - length - 8 * PERIOD
    sizes = windows_of + length - 1
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin, windows_of) + np.arange(int(windows_of.sum())) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of)
    frag = np.repeat(np.arange(len(contents)), windows_of)
    where = np.full(n, -1, np.int64)
    where[starts] = np.arange(len(starts))
    rows = np.lib.stride_tricks.sliding_window_view(text, length)
    out = np.empty(len(starts), np.int64)
    for pos in sort_suffixes(text, n, starts, length):
        new = np.ones(len(pos), bool)
        for a in range(1, len(pos), 1 << 16):
            b = min(len(pos), a + (1 << 16))
            new[a:b] = (rows[pos[a:b]] != rows[pos[a - 1 : b - 1]]).any(axis=1)
        at, w = np.flatnonzero(new), where[pos]
        out[w] = np.minimum.reduceat(least[frag[w]], at)[np.cumsum(new) - 1]
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts in a document of smaller id.

    Returns id_col, n_bytes, n_removed, spans array<struct<start,end>> of removed byte runs, kept binary.
    Null text: empty.  Null id: after every other id.  Rows with one id are one document in comparisons.  Texts shorter
    than ``length`` bytes are kept.  Empty tables give empty results; further columns are left out, whatever their names.
    """
    out = windows.remove_repeats(docs, windows.Bytes(length, min(24, length)), least_documents, id_col, text)
    return out.withColumnRenamed("n_units", "n_bytes")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
