"""Context-mixing range coder for token ids, many blocks side by side.

Every block of at most ``BLOCK`` ids (fewer in short files) is coded by itself from a fresh state, with a checksum, so blocks can be read (or found
broken) alone.  Blocks run in lockstep as lanes of numpy arrays: a step codes one id of each.

Ids are coded by their rank in the file's table, commonest first.  Model of a lane: what followed the last two ids and what
followed the last id here before (order 2, order 1), each with a confidence; their adaptive probabilities are mixed in the
logistic domain with weights learnt as it goes, giving the probability that the prediction holds.  If it doesn't, order 0
says which id it is: the rank's bit length by adaptive frequencies, the file's to begin with, renewed every ``RENEW`` steps, and, since ids of one bit
length are about equally common, the rank's lower bits in equal parts of what is left of the range.
The table heads the file with a checksum of its own; a block needs it and nothing else.  All model arithmetic is in integers.

Arrays hold both orders at once (first row: order 1), and all lanes take every step of the arithmetic, hit or not: whole
rows cost less than picking the lanes that need it.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
LEAST_BLOCK = 1024
LANES = 2048
SLOTS = 1 << 12  # at most, and no more than twice a block's ids
MAGIC = b"VTOK4\0\0\0"
NARROW = 1 << 22  # ids below are counted in an array
RENEW = 32
ONE = 12  # bits of a probability
SURE = 7  # the highest confidence, kept beside an id in 3 bits
_LEAST = np.uint64(1 << 48)
_STRETCH = np.array([0, *[round(256 * np.log(p / (4096 - p))) for p in range(1, 4096)]], np.int32)
_STRETCH[0] = _STRETCH[1]
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + np.exp(-x / 256))))) for x in range(-2048, 2048)], np.uint64)
_U, _L = np.uint32, np.uint64
PRIOR = 800  # what the file's classes count for at the start of a block; an id counts for 24
#: how often a guess holds at first, of 4096, by confidence; from 8 on: order 1 says otherwise than order 2
_HOLDS = np.array([[128, 256, 1152, 1664, 1664, 1664, 1664, 1792, 96, 96, 448, 896, 960, 1024, 1024, 1024], [320, 160, 1536, *[2048] * 13]], np.int32)


class _Model:
    def __init__(self, lanes: int, longest: int, distinct: int, classes: np.ndarray):
        self.n = self.lanes = lanes
        slots = min(SLOTS, 1 << max(longest - 1, 1).bit_length())
        self.mask, self.down = _L(slots - 1), _L(65 - slots.bit_length())
        self.classes = len(classes)
        self.lane = np.arange(lanes)
        self.row = np.stack([self.lane, self.lane + lanes]) * slots
        self.state = np.stack([self.lane, self.lane + lanes]) * 16
        self.table = np.zeros(2 * lanes * slots, np.uint16 if distinct <= 1 << 13 else np.uint32)  # rank << 3 | confidence
        self.p = np.concatenate([np.tile(holds, lanes) for holds in _HOLDS])
        self.w = np.full((2, lanes), 1 << 15, np.int32)
        classes = classes.astype(np.int64)
        self.count = np.repeat((classes * PRIOR // max(int(classes.sum()), 1) + 1).astype(np.int32)[:, None], lanes, axis=1)
        self.seen, self.kept = np.empty((RENEW, lanes), np.int64), 0
        self.a, self.b = np.zeros(lanes, _L), np.zeros(lanes, _L)  # the last rank, and the one before, multiplied

    def start(self, t: int, n: int) -> None:
        """Step t, with the first n lanes."""
        if n < self.n:
            self.note()
            self.lane, self.a, self.b = self.lane[:n], self.a[:n], self.b[:n]
            self.row, self.state, self.w = self.row[:, :n], self.state[:, :n], self.w[:, :n].copy()
            self.n = n
        if t % 8 == 0:  # between, weights move by less than 2 ** 17, and products stay below 2 ** 30
            np.minimum(np.maximum(self.w, -(1 << 18), out=self.w), 1 << 18, out=self.w)
        if t % RENEW == 0 or t < RENEW and t & (t - 1) == 0:
            self.note()
            count = self.count
            total = count.sum(axis=0, dtype=np.int32)
            f = count * np.int32((1 << ONE) - self.classes) // total + np.int32(1)
            f[f.argmax(axis=0), np.arange(self.lanes)] += (1 << ONE) - f.sum(axis=0, dtype=np.int32)
            first = np.cumsum(f, axis=0, dtype=np.int32) - f
            self.first, self.goals = first.astype(_L).reshape(-1), first[1:].astype(np.uint16)
            self.f = f.astype(_L).reshape(-1)
            big = total > 1 << 13
            if big.any():
                count[:, big] = (count[:, big] + 1) >> 1

    def note(self) -> None:
        """Counts the classes of the steps since the last time."""
        if self.kept:
            seen = np.bincount(self.seen[: self.kept, : self.n].ravel(), minlength=(self.classes + 1) * self.lanes)
            self.count += 24 * seen[: self.classes * self.lanes].reshape(self.classes, self.lanes).astype(np.int32)
            self.kept = 0

    def predict(self) -> np.ndarray:
        """Sets guess; the probability that it holds, of 4096."""
        h = self.a * _L(11400714819323198485)
        h ^= self.b
        h >>= self.down
        self.i = i = self.row.copy()
        i[0] += (self.a & self.mask).view(np.int64)
        i[1] += h.view(np.int64)
        self.e = e = self.table.take(i)
        kind = e.dtype.type
        self.c = c = e & kind(SURE)
        chosen = np.where(c[1] > 0, e[1], e[0])
        self.guess = chosen >> kind(3)
        k = c.copy()
        k[0] |= ((e[0] ^ chosen) > SURE).astype(kind) << kind(3)  # 8 and on: order 1 says otherwise
        self.k = k.astype(np.int64)
        self.k += self.state
        self.q = self.p.take(self.k)
        self.s = _STRETCH.take(self.q)
        dot = self.w * self.s
        dot = dot[0] + dot[1]
        dot >>= 16
        dot += 2048
        self.odds = _SQUASH.take(dot, mode="clip")
        return self.odds

    def update(self, ranks: np.ndarray, hit: np.ndarray) -> None:
        y = hit.astype(np.int32)
        err = y << ONE
        err -= self.odds.astype(np.int32)
        s = self.s
        s *= err
        s >>= 10
        self.w += s
        y *= 4047
        y += 32
        q = y - self.q
        q >>= 4
        q += self.q
        self.p[self.k] = q  # 32 to 4064
        e, c, kind = self.e, self.c, self.e.dtype.type
        packed = ranks.astype(kind) << kind(3)
        same = e ^ packed
        same -= kind(1)
        packed |= kind(1)
        self.table[self.i] = np.where(same < SURE, e + (c < SURE), np.where(c > 3, e - kind(3), packed))
        self.b = self.a * _L(0xD6E8FEB86659FD93)
        self.a = ranks.astype(_L)


class _Encoder:
    """Range coder: 64-bit state; words of 16 bits leave when the range is below 2 ** 48, a carry goes into words that have left."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _L), np.full(lanes, ~_L(0))
        self.lanes, self.out, self.at = lanes, np.zeros(lanes * room, "<u2"), np.arange(lanes)  # a row: a word of each lane

    def add(self, n: int, more: np.ndarray) -> None:
        low = self.low[:n]
        low += more
        at = self.at[:n][low < more]
        while len(at):
            at -= self.lanes
            word = self.out[at] + np.uint16(1)
            self.out[at] = word
            at = at[word == 0]

    def renew(self, n: int) -> None:
        go = np.flatnonzero(self.range[:n] < _LEAST)
        while len(go):
            low, at = self.low[go], self.at[go]
            self.out[at] = low >> _L(48)
            self.at[go] = at + self.lanes
            self.low[go] = low << _L(16)
            rng = self.range[go] << _L(16)
            self.range[go] = rng
            go = go[rng < _LEAST]

    def finish(self) -> list[bytes]:
        """The shortest number in the range: one more word, zeros follow."""
        self.add(len(self.low), np.full(len(self.low), _LEAST - _L(1)))
        self.out[self.at] = self.low >> _L(48)
        words = self.at // self.lanes + 1
        rows = np.ascontiguousarray(self.out.reshape(-1, self.lanes)[: int(words.max())].T)
        return [rows[j, :n].tobytes() for j, n in enumerate(words.tolist())]


class _Decoder:
    def __init__(self, parts: list[bytes]):
        n = len(parts)
        rows = np.zeros((n, max(map(len, parts)) // 2 + 5), "<u2")
        for j, p in enumerate(parts):
            rows[j, : len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
        self.lanes, self.data, self.at = n, np.ascontiguousarray(rows.T).reshape(-1), np.arange(n) + 4 * n
        self.range, self.code = np.full(n, ~_L(0)), np.zeros(n, _L)  # code: above the range's low end
        for c in range(4):
            self.code = (self.code << _L(16)) | rows[:, c]

    def renew(self, n: int) -> None:
        go = np.flatnonzero(self.range[:n] < _LEAST)
        while len(go):
            at = self.at[go]
            self.code[go] = (self.code[go] << _L(16)) | self.data.take(at, mode="clip")  # damaged blocks may ask for more
            self.at[go] = at + self.lanes
            rng = self.range[go] << _L(16)
            self.range[go] = rng
            go = go[rng < _LEAST]


def _bits(distinct: int) -> np.ndarray:
    """The bit length of each rank."""
    return np.frexp(np.arange(distinct, dtype=np.float64))[1].astype(np.int64)


def _run(lengths: np.ndarray, distinct: int, classes: np.ndarray, ranks: np.ndarray | None, parts: list[bytes] | None):
    """Codes lanes (longest first): ranks (lanes x longest) to parts, or parts to ranks."""
    lanes, longest = len(lengths), int(lengths.max())
    model, encode = _Model(lanes, longest, distinct, classes), parts is None
    if encode:
        coder, steps = _Encoder(lanes, 4 * longest + 8), np.ascontiguousarray(ranks.T)
        bits = _bits(distinct)
    else:
        coder, steps = _Decoder(parts), np.zeros((longest, lanes), _U)
    one, unit, none = _L(ONE), _L(1), np.int64(model.classes * lanes)
    for t in range(longest):
        n = lanes if t < lengths[-1] else int(np.searchsorted(-lengths, -t, "left"))  # lanes with an id at t
        model.start(t, n)
        p = model.predict()
        rng = coder.range[:n]
        split = rng >> one
        split *= p
        left = rng - split
        left >>= one
        x = steps[t, :n]
        if encode:
            hit = x == model.guess
            k = bits.take(x)
        else:
            code = coder.code[:n]
            hit = code < split
            rest = code - split
            goal = np.minimum(rest // left, _L((1 << ONE) - 1)).astype(np.uint16)
            k = np.add.reduce((model.goals[:, :n] <= goal).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        at = k * lanes
        at += model.lane
        first = model.first.take(at)
        first *= left
        left *= model.f.take(at)
        k = k.view(_L)
        top = unit << k
        top >>= unit
        left >>= np.maximum(k, unit) - unit
        if encode:
            more = x - top
            more *= left
            more += first
            more += split
            more[hit] = 0
            coder.add(n, more)
        else:
            rest -= first
            v = np.minimum(rest // left, np.maximum(top, unit) - unit)
            rest -= v * left
            v += top
            x[:] = np.where(hit, model.guess, v)
            code[:] = np.where(hit, code, rest)
        rng[:] = np.where(hit, split, left)
        model.seen[model.kept, :n] = np.where(hit, none, at)
        model.kept += 1
        coder.renew(n)
        model.update(x, hit)
    return coder.finish() if encode else steps.T


def block_for(n: int, lanes: int = LANES) -> int:
    """The block size of a file of n ids: BLOCK, shorter where that leaves lanes empty, since a step's cost hardly falls with its lanes."""
    return min(BLOCK, max(LEAST_BLOCK, -(-n // (lanes * 64)) * 64))


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, commonest first (ids of ranks of one bit length ascending), how often each occurs, and each id's rank."""
    if len(ids) and int(ids.max()) < NARROW:
        seen = np.bincount(ids)
        values, inverse = np.flatnonzero(seen), None
        counts = seen[values]
    else:
        values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    for k in range(len(order).bit_length()):
        order[1 << k : 2 << k].sort()
    rank = np.empty(len(order), _U)
    rank[order] = np.arange(len(order), dtype=_U)
    if inverse is not None:
        return values[order].astype("<u4"), counts[order], rank[inverse]
    by_id = np.zeros(len(seen), _U)
    by_id[values] = rank
    return values[order].astype("<u4"), counts[order], by_id.take(ids)


def _pack_table(table: np.ndarray) -> bytes:
    """Differences of neighbours (mod 2 ** 32), all lowest bytes first, deflated."""
    return zlib.compress(np.diff(table, prepend=_U(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 9)


def _unpack_table(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=_U)


def encode(ids: np.ndarray, block: int | None = None, lanes: int = LANES) -> bytes:
    """A file image: magic, ids, block size, bytes and checksum of the packed table, the table (how many ids have ranks of each bit length, then the ids by rank), then per block its bytes and the checksum of its ids and bytes, then the blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    block = block or block_for(n, lanes)
    table, counts, codes = _ranked(ids)
    classes = np.bincount(_bits(len(table)), weights=counts).astype("<u4")
    packed = bytes([len(classes)]) + classes.tobytes() + _pack_table(table)
    sizes = np.full(-(-n // block), block, np.int64)
    if n % block:
        sizes[-1] = n % block
    parts: list[bytes] = []
    for a in range(0, len(sizes), lanes):
        s = sizes[a : a + lanes]
        grid = np.zeros((len(s), block), _U)
        grid.reshape(-1)[: int(s.sum())] = codes[a * block : a * block + int(s.sum())]
        parts += _run(s, len(table), classes, grid[:, : s[0]], None)
    head = np.array([[len(p), zlib.crc32(p, zlib.crc32(ids[j * block : (j + 1) * block].tobytes()))] for j, p in enumerate(parts)], "<u4").reshape(-1, 2)
    return MAGIC + np.array([n, block, len(packed), zlib.crc32(packed)], "<u8").tobytes() + packed + head.tobytes() + b"".join(parts)


def decode(image: bytes, lanes: int = LANES) -> np.ndarray:
    """The ids of a file image; raises ValueError if it isn't one or the checksum of the table or of a block differs."""
    if image[:8] != MAGIC:
        raise ValueError("not a token file")
    n, block, size, crc = (int(x) for x in np.frombuffer(image, "<u8", 4, 8))
    packed = image[40 : 40 + size]
    if zlib.crc32(packed) != crc:
        raise ValueError("the table is damaged")
    classes = np.frombuffer(packed, "<u4", packed[0], 1)
    table = _unpack_table(packed[1 + 4 * packed[0] :])
    count = -(-n // block)
    head = np.frombuffer(image, "<u4", 2 * count, 40 + size).reshape(-1, 2).astype(np.int64)
    at = 40 + size + 8 * count + np.concatenate([[0], np.cumsum(head[:, 0])])
    sizes = np.full(count, block, np.int64)
    if n % block:
        sizes[-1] = n % block
    out = np.empty(n, "<u4")
    for a in range(0, count, lanes):
        s = sizes[a : a + lanes]
        parts = [image[at[j] : at[j + 1]] for j in range(a, a + len(s))]
        got = np.ascontiguousarray(_run(s, len(table), classes, None, parts))
        for j, m in enumerate(s.tolist()):
            ids = table.take(got[j, :m], mode="clip")
            if got[j, :m].max() >= len(table) or zlib.crc32(parts[j], zlib.crc32(ids.tobytes())) != head[a + j, 1]:
                raise ValueError(f"block {a + j} is damaged")
            out[(a + j) * block : (a + j) * block + m] = ids
    return out
