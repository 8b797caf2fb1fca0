"""Token ids of whole texts by way of their distinct units.

A pre-tokeniser never joins what stands on both sides of certain places, so a text's ids are those of its units in turn.
Many texts are cut at such places at once, by the classes of their bytes, and their units counted as one dictionary, of
which each is encoded about once a worker; up to about ``most`` units are remembered.
"""

from __future__ import annotations

import os
import re
import struct
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import store

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Unicode White_Space, which the tokenizers' \s stands for (Python's \s has four control characters more)
_WS = "\t-\r \x85\xa0  -     　"
_SLOW = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: white space beyond ASCII's
_WIDE = re.compile(f"[{_WS[_WS.index(chr(0x85)):]}]")
#: units whose pre-tokens are plain: Latin-1 letters, digits, ASCII marks but the apostrophe, after at most one space
_PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(1, 6)
#: classes of bytes; a Latin-1 letter is 0xC3 and one of 0x80 to 0xBF but for the signs × and ÷
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[b for b in range(33, 127) if chr(b) != "'" and not chr(b).isalnum()]] = _MARK
_CLASS[[0x97, 0xB7]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: byte-level alphabets write a byte as the character of its number, or, where that isn't a visible one, as 256 and on
_SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS = {b: b for b in _SEEN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_BYTES = "".join(chr(_AS[b]) for b in range(256))
_PACK = [struct.Struct(f"<{k}I").pack for k in range(65)]
#: bytes of text that are cut at once
_AT_ONCE = 6 << 20
_CACHE: dict[str, tuple] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _join(a: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of a put together, the i-th of n[i] items from at[i] on."""
    at = np.repeat(at - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return a.take(at)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy if n items don't fit."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class _Held:
    """Units and their ids, looked up many at once.

    A unit of at most LONGEST bytes is a key of three numbers, its bytes and its length, so that equal keys are equal units; it may
    stand in two neighbouring places of a table, the newer ones first.  What is pushed out is encoded anew.  Others are in a dict.
    """

    LONGEST = 23
    PLACES = 22  # as bits
    _MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def __len__(self) -> int:
        return self.n

    def clear(self) -> None:
        self.n = self.used = 0
        self.places = np.full(1 << self.PLACES, -1, np.int32)
        self.keys = [np.zeros(1 << 12, np.uint64) for _ in range(3)]
        self.at, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")
        self.others: dict[str, int] = {}

    def look(self, buf: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Numbers of the units at off, of n bytes (-1: not held), their keys and places."""
        words = np.ndarray(len(buf) + 1, "<u8", np.append(buf, np.zeros(24, np.uint8)), strides=(1,))
        keys = [words[np.minimum(off + 8 * j, len(buf))] & self._MASK[np.clip(n - 8 * j, 0, 8)] for j in range(3)]
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k, odd in zip(keys[1:], (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD), strict=True):
            h ^= h >> np.uint64(31)
            h += k
            h *= np.uint64(odd)
        place = (h >> np.uint64(64 - self.PLACES)).view(np.int64)
        found = np.full(len(off), -1, np.int64)
        for way in (0, 1):
            left = np.flatnonzero(found < 0)
            e = self.places[place[left] ^ way].astype(np.int64)
            same = (e >= 0) & (n[left] <= self.LONGEST)
            for mine, key in zip(self.keys, keys, strict=True):
                same &= mine[e] == key[left]
            found[left[same]] = e[same]
        return found, keys, place

    def add(self, ids: list[bytes]) -> np.ndarray:
        """Numbers of new units with these ids."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        a, b = self.n, self.n + len(ids)
        self.at, self.size, self.ids = _grown(self.at, b), _grown(self.size, b), _grown(self.ids, self.used + int(size.sum()))
        self.size[a:b], self.at[a:b] = size, self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + int(size.sum())] = np.frombuffer(b"".join(ids), "<u4")
        self.n, self.used = b, self.used + int(size.sum())
        return np.arange(a, b)

    def put(self, e: np.ndarray, keys: list[np.ndarray], place: np.ndarray) -> None:
        """Units e are found by these keys from now on."""
        self.keys = [_grown(k, self.n) for k in self.keys]
        for mine, key in zip(self.keys, keys, strict=True):
            mine[e] = key
        old = self.places[place]
        self.places[place[old >= 0] ^ 1] = old[old >= 0]
        self.places[place] = e
        lost = self.places[place] != e  # to another of these
        self.places[place[lost] ^ 1] = e[lost]


class UnitEncoder:
    """Little-endian 32-bit ids of texts; kind "words": white space only separates; kind "bytes": it belongs to what follows."""

    def __init__(self, path: str, kind: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Held(most)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, n = self.ids(pa.array(texts, pa.large_string()))
        raw, to = ids.tobytes(), 4 * np.cumsum(n)
        return [raw[b - 4 * k : b] for b, k in zip(to.tolist(), n.tolist(), strict=True)]

    def ids(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, each followed by ``end`` if given, and how many each has. Null text: empty."""
        out, counts, a = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while a < len(texts):
            to = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _AT_ONCE, "right")))
            got = self._some(texts.slice(a, to - a), end)
            out.append(got[0])
            counts.append(got[1])
            a = to
        return np.concatenate(out), np.concatenate(counts)

    def _some(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        buf, off = store.texts_of({"text": texts}, "text")
        slow = self._slow(texts, buf, off) if self.kind == "bytes" else []
        if slow:  # their units are found by a regular expression and stand in for them
            whole = texts.to_pylist()
            units = [[whole[i]] if any(s in whole[i] for s in self.special) else _SLOW.findall(whole[i]) for i in slow]
            keep = np.ones(len(whole), bool)
            keep[slow] = False
            buf, off = store.texts_of({"text": pc.if_else(pa.array(keep), texts, pa.scalar("", texts.type))}, "text")
        starts, buf = self._starts(buf, off)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(buf)).dictionary_encode()
        words, more, codes = pieces.dictionary, {}, pieces.indices.to_numpy().astype(np.int64)
        n = np.diff(np.searchsorted(starts, off))
        if slow:
            theirs = [[more.setdefault(u, len(words) + len(more)) for u in part] for part in units]
            codes = np.insert(codes, np.repeat((np.cumsum(n) - n)[slow], [len(m) for m in theirs]), [c for m in theirs for c in m])
            n[slow] = [len(m) for m in theirs]
        ids, size = self._known(words, list(more))
        if end is not None:
            codes = np.insert(codes, np.cumsum(n), len(size))
            ids, size = np.append(ids, np.uint32(end)), np.append(size, 1)
            n += 1
        long = size.take(codes)
        per = np.concatenate([[0], np.cumsum(long)])
        to = np.concatenate([[0], np.cumsum(n)])
        return _join(ids, (np.cumsum(size) - size).take(codes), long), np.diff(per[to])

    def _slow(self, texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> list[int]:
        """Texts with added tokens or with white space beyond ASCII's, which may stand beside other white space."""
        found: set[int] = set()
        for s in self.special:
            found.update(np.flatnonzero(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)).tolist())
        lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
        found.update(i for i in np.unique(np.searchsorted(off, lead, "right") - 1).tolist() if _WIDE.search(texts[i].as_py()))
        return sorted(found)

    def _starts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units start: a text, a change of class, the last of some white space, to which what follows belongs if it is a space; with kind "words" each digit.

        And the bytes, with kind "words" plain letters in lower case.
        """
        if not len(buf):
            return np.zeros(0, np.int64), buf
        cls = _CLASS.take(buf)
        first = np.unique(off[:-1][off[:-1] < len(buf)])
        white = cls == _SPACE
        before, after = np.empty(len(buf), np.uint8), np.empty(len(buf), bool)
        before[1:], after[:-1] = cls[:-1], ~white[1:]
        before[first], after[np.append(first[1:], len(buf)) - 1] = 0, False
        start = cls != before
        if self.kind == "words":
            start |= cls == _DIGIT
        start |= white & after
        odd = cls == _OTHER
        odd[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)  # <|
        odd = np.flatnonzero(odd)
        same = None
        if len(odd):  # all between white space is left to the library
            runs = np.flatnonzero(~white & ((before == _SPACE) | (before == 0)))
            stops = np.flatnonzero(~white & (np.append(white[1:], True) | np.append(before[1:] == 0, True))) + 1
            r = np.unique(np.searchsorted(runs, odd, "right") - 1)
            deep = np.zeros(len(buf) + 1, np.int8)
            deep[runs[r] + 1] += 1
            np.subtract.at(deep, stops[r], 1)
            start &= np.cumsum(deep[:-1], dtype=np.int8) == 0
            if self.kind == "words":
                deep[runs[r] + 1] -= 1
                deep[runs[r]] += 1
                same = np.cumsum(deep[:-1], dtype=np.int8) != 0
        blank = np.flatnonzero((buf == 32) & after) + 1
        start[blank] = False
        if self.kind == "words":
            low = _LOWER.take(buf)
            low[1:] += ((buf[:-1] == 0xC3) & (buf[1:] < 0x9F)).view(np.uint8) << 5
            buf = low if same is None else np.where(same, buf, low)
        return np.flatnonzero(start), buf

    def _known(self, words: pa.StringArray, more: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and then of ``more``, one after another, and how many each has."""
        held = self.cache
        if len(held) > held.most:
            held.clear()
        buf, off = store.texts_of({"text": words}, "text")
        n, off = np.diff(off), off[:-1]
        found, keys, place = held.look(buf, off, n)
        fresh = np.flatnonzero(found < 0)
        found = np.append(found, np.full(len(more), -1))
        units = words.take(pa.array(fresh)).to_pylist() + more
        fresh = np.append(fresh, np.arange(len(words), len(found)))
        if held.others:
            found[fresh] = [held.others.get(u, -1) for u in units]
            left = np.flatnonzero(found[fresh] < 0)
            fresh, units = fresh[left], [units[i] for i in left.tolist()]
        found[fresh] = e = held.add(self._encode(units))
        short = fresh < len(words)
        short[short] = n[fresh[short]] <= held.LONGEST
        at = fresh[short]
        held.put(e[short], [k[at] for k in keys], place[at])
        held.others.update((units[i], int(e[i])) for i in np.flatnonzero(~short).tolist())
        size = held.size.take(found)
        return _join(held.ids, held.at.take(found), size), size

    def _encode(self, units: list[str]) -> list[bytes]:
        """Each unit's ids, by the library."""
        got: list[bytes] = [b""] * len(units)
        words, tokenize, rest = self.kind == "words", self.tokenizer.model.tokenize, []
        for i, u in enumerate(units):
            if not _PLAIN.fullmatch(u) or "<|" in u:
                rest.append(i)
                continue
            p = u
            if words:
                p = u.lstrip(" ")
                if len(p) > 1 and p.isdigit():
                    rest.append(i)
                    continue
            # one pre-token, so that the model's ids are the library's
            ids = [t.id for t in tokenize(p.replace(" ", _BYTES[32]) if p.isascii() else charmap_decode(p.encode(), "strict", _BYTES)[0])]
            got[i] = _PACK[len(ids)](*ids) if len(ids) < 65 else np.array(ids, "<u4").tobytes()
        for a in range(0, len(rest), 1 << 14):
            part = rest[a : a + (1 << 14)]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([units[i] for i in part], add_special_tokens=False), strict=True):
                got[i] = np.array(e.ids, "<u4").tobytes()
        return got


def encoder(path: str, kind: str) -> UnitEncoder:
    """This worker's encoder of that file, kept between tasks."""
    if (path, kind) not in _CACHE:
        _CACHE[path, kind] = UnitEncoder(path, kind)
    return _CACHE[path, kind]
