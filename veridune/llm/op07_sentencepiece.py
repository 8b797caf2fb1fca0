"""SentencePiece encoding and decoding with prefixes shared between words.

A text's marked words (each run of words and the mark for the space before it) are encoded apart, each distinct one once
a batch.  Sorted, the distinct words are a trie in depth-first order: the forward table of a word is that of the prefix it
shares with the word before, cut back to it and carried on.

Unigram models: forward scores are best sums of piece scores (Viterbi).  BPE models have no additive scores; there the
forward entry of a prefix is the last piece of its encoding, the one whose predecessor (the entry of the shorter prefix)
it would stand beside without a merge across the border.  A prefix has just one such piece, so the forward pass is the
same and needs no backward search.  Where no piece stands, the word is merged pair by pair.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .units import default_path

MARK = "▁"
MOST_WORDS = 600_000
_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces and scores of a model file, and encoding of marked words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id), default=1)
        self.unigram = "unigram" in str(type(sp)).lower() or self._is_unigram(sp)
        self.is_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.bytes_of = [bytes([self.is_byte[i]]) if i in self.is_byte else b"" if i in self.control else p.encode() if i != self.unknown else " ⁇ ".encode() for i, p in enumerate(self.pieces)]
        self.texts = pa.array([b.decode("utf-8", "surrogateescape").replace(MARK, " ").encode("utf-8", "surrogateescape") for b in self.bytes_of], pa.large_binary())
        self.partial = np.array([self.is_byte.get(i, 0) >= 128 for i in range(n)])  # part of a character
        self.beside: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.whole = {p for p in self.id if len(p) == 1 or self.merges(p) == [p]}

    def _is_unigram(self, sp) -> bool:
        # BPE scores are the negative ranks of the merges
        s = [v for v in self.score.values() if v]
        return not all(float(v).is_integer() for v in s[:1000])

    def merges(self, word: str) -> list[str]:
        """Plain BPE: the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts = list(word)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        got = self.beside.get((a, b))
        if got is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            got = self.beside[a, b] = self.merges(a + b) == [a, b]
        return got

    def encode_sorted(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the sorted distinct words; the forward table is shared along common prefixes."""
        table: list = [("", 0.0)]  # table[i]: (last piece of the prefix of i characters, score of that prefix)
        last = ""
        whole, score, longest, fits = self.whole, self.score, self.longest, self.fits
        for word in words:
            k, most = 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del table[k + 1 :]
            for i in range(k + 1, len(word) + 1):
                choice = None
                if self.unigram:
                    best = -1e300
                    for j in range(max(0, i - longest), i):
                        s = score.get(word[j:i])
                        if s is None and i - j == 1:
                            s = -1e6
                        if s is not None and table[j][1] + s > best:
                            best, choice = table[j][1] + s, word[j:i]
                    table.append((choice, best))
                    continue
                for j in range(max(0, i - longest), i):
                    piece = word[j:i]
                    if (piece in whole or i - j == 1) and (not j or fits(table[j][0], piece)):
                        choice = piece
                        break
                table.append((choice or word[i - 1 : i], 0.0 if choice else 1.0))
            last = word
            out, i, sure = [], len(word), True
            while i > 0:
                piece, doubt = table[i]
                out.append(piece)
                i -= len(piece)
                sure &= self.unigram or not doubt
            out.reverse()
            yield out if sure else self.merges(word)

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def split(self, text: str) -> list[str]:
        """Marked words: a run of marks belongs to the word behind it."""
        if not text:
            return []
        words = text.replace(" ", MARK).split(MARK)
        if "" not in words:  # no runs of marks
            return [MARK + w for w in words]
        first, *rest = words
        out, held = [], MARK + first
        for w in rest:
            if held.strip(MARK):
                out.append(held)
                held = MARK + w
            else:
                held += MARK + w
        out.append(held)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > MOST_WORDS:  # two generations: what is used stays
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        fresh: set[str] = set()
        for s in split:
            fresh.update(s)
        fresh.difference_update(cache)
        words = []
        for w in fresh:
            got = old.get(w)
            if got is None:
                words.append(w)
            else:
                cache[w] = got
        words.sort()
        for w, parts in zip(words, self.encode_sorted(words), strict=True):
            ids = self.ids_of(parts)
            cache[w] = struct.pack(f"<{len(ids)}i", *ids)
        return [b"".join([cache[w] for w in s]) for s in split]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


    def decode_lists(self, values: np.ndarray, ends: np.ndarray) -> pa.Array:
        """decode() of the lists values[ends[i]:ends[i + 1]]: pieces' texts one after another, lists with parts of characters by themselves."""
        values = values[ends[0] : ends[-1]]
        ends = (ends - ends[0]).astype(np.int64)
        if not len(values):
            return pa.array([""] * (len(ends) - 1), pa.large_string())
        taken = self.texts.take(pa.array(values))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        parts = np.concatenate([[0], np.cumsum(self.partial[values])])
        alone = parts[ends[1:]] > parts[ends[:-1]]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[ends])), taken.buffers()[2]])
        raw = pc.if_else(pc.starts_with(raw, b" "), pc.binary_replace_slice(raw, 0, 1, b""), raw)
        if alone.any():
            own = iter([self.decode(values[ends[i] : ends[i + 1]].tolist()).encode() for i in np.flatnonzero(alone)])
            raw = pc.replace_with_mask(raw, pa.array(alone), pa.array(list(own), pa.large_binary()))
        return raw.cast(pa.large_string())


def model(path: str | None) -> PieceModel:
    path = path or default_path("piece_bpe_32k.model")
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _encode(path: str | None):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a in range(0, len(texts), 512):
                got = m.encode([t or "" for t in texts[a : a + 512]])
                size = np.array([len(g) // 4 for g in got])
                values = pa.array(np.frombuffer(b"".join(got), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch["id"][a : a + 512], ids], names=["id", "ids"])

    return rows


def _decode(path: str | None):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy()
            values = pc.list_flatten(batch["ids"]).to_numpy(zero_copy_only=False)
            text = m.decode_lists(values, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([batch["id"], text.cast(pa.string())], names=["id", "text"])

    return rows


def _round_trip(path: str | None):
    """Ids of each text, and the text decoded from those ids."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in _encode(path)(batches):
            ids = batch["ids"]
            values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            text = m.decode_lists(values, ends).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], ids, text], names=["id", "ids", "decoded"])

    return rows


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """id_col and ids array<int> of each whole text by the model file ``path`` (default piece_bpe_32k.model).

    Null or empty texts have no ids.  Null ids and repeated rows pass through.  No start or end id is added.  Texts and words may
    have any length; further columns, of whatever names, are left out.  Empty table: empty result.
    """
    store.ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = src.mapInArrow(_encode(path), "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and text of each row's ids; null ids give an empty text."""
    store.ship(encoded.sparkSession)
    out = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids).alias("ids")).mapInArrow(_decode(path), "id long, text string")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store.ship(spark)
    out = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_round_trip(None), "id long, ids array<int>, decoded string")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("decoded").alias("decoded_hash"))
