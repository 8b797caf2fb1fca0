import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veridune.llm import mixcoder, units
from veridune.llm import op08_token_files as o8
from veridune.llm import op09_best_fit_packing as o9

SCHEMA = "doc_id long, text string, start string, n_tokens string"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b\n", "a\n b", "a \n b", "a\n\n b  ", "x\n ", "\x1c a \x1fb\x0b c", "é  ü  ß　x", "é ́x", "<|endoftext|> a <|startoftext|>b\n <|endoftext|>", "don't won't I'll 123 45,6!? ..", "ＡＢＣ １２", "İstanbul ǅ"]


def texts():
    import duckdb

    return ODD + [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_units_give_the_tokenizers_ids(name, kind):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    enc = units.UnitEncoder(public_tokenizers.path(name), kind)
    r = random.Random(1)
    some = texts() + ["".join(r.choice(["a", "B", " ", " ", "\n", "\t", "é", "'s", "1", " ", "."]) for _ in range(40)) for _ in range(2000)]
    for text, ids in zip(some, enc.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:80])


def rows_of():
    return [(3 * i % 997, t, "", "") for i, t in enumerate(texts())] + [(5000, None, None, None), (7, "the same id", "", ""), (None, "no id", "", "")]


def test_token_files(spark, tmp_path):
    rows = rows_of()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    o8.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "f"), most=9000)
    got = sorted(o8.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    want = {}
    for d, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    big = [1 << 62 if r.doc_id is None else r.doc_id for r in got]
    assert big == sorted(big)
    at, seen = 0, {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    o8.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert o8.read_token_files(spark, str(tmp_path / "e")).collect() == []


def test_mixcoder_is_no_larger_than_adaptive_frequencies_of_ids():
    """Against the ideal size of blocks coded by counts of ids so far in the block (each of the file's ids once to begin with)."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.concatenate([np.array(e.ids + [2], "<u4") for e in t.encode_batch(texts(), add_special_tokens=False)])
    block, distinct, bits = mixcoder.block_for(len(ids)), len(np.unique(ids)), 0.0
    for a in range(0, len(ids), block):
        seen = {}
        for j, x in enumerate(ids[a : a + block].tolist()):
            bits -= np.log2((seen.get(x, 0) + 1) / (j + distinct))
            seen[x] = seen.get(x, 0) + 1
    image = mixcoder.encode(ids)
    assert (mixcoder.decode(image) == ids).all()
    assert 8 * len(image) <= bits


def test_a_damaged_table_is_found():
    image = bytearray(mixcoder.encode(np.arange(3000, dtype="<u4")))
    image[45] ^= 1
    with pytest.raises(ValueError):
        mixcoder.decode(bytes(image))


@pytest.mark.parametrize("case", ["random", "repeats", "one", "wide", "empty", "zero"])
def test_mixcoder_round_trip(case):
    r = np.random.default_rng(7)
    ids = {
        "random": r.integers(0, 50257, 9000),
        "repeats": np.tile(r.integers(0, 300, 700), 20),
        "one": np.array([5]),
        "wide": r.integers(0, 1 << 32, 3000),
        "empty": np.zeros(0, int),
        "zero": np.zeros(5000, int),
    }[case].astype("<u4")
    image = mixcoder.encode(ids, block=512, lanes=7)
    assert (mixcoder.decode(image, lanes=5) == ids).all() and len(mixcoder.decode(image)) == len(ids)
    if case == "repeats":
        assert len(mixcoder.encode(ids)) < 0.5 * 2 * len(ids)
    if len(ids) > 100:
        broken = bytearray(image)
        broken[-40] ^= 255
        with pytest.raises(ValueError):
            mixcoder.decode(bytes(broken))


def test_block_sizes_fill_the_lanes():
    assert [mixcoder.block_for(n) for n in (0, 1, 2048 * 1024, 2048 * 1024 + 1, 2048 * 4096, 1 << 40)] == [1024, 1024, 1024, 1088, 4096, 4096]
    ids = np.random.default_rng(1).integers(0, 500, 70_000).astype("<u4")
    image = mixcoder.encode(ids, lanes=64)
    assert np.frombuffer(image, "<u8", 1, 16)[0] == 1152 and (mixcoder.decode(image) == ids).all()


def test_packing(spark):
    rows = rows_of()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = 128
    got = o9.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size).collect()
    want = []
    for d, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(-1 if d is None else d, p // size, p, len(ids[p : p + size]), zlib.crc32(ids[p : p + size].tobytes())) for p in range(0, len(ids), size)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= size
    need = -(-sum(w[3] for w in want) // size)
    assert len(by) <= 1.02 * need + 2
    assert o9.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_covers_the_histogram_and_is_close():
    r = np.random.default_rng(3)
    for spread in (400, 1500, 2047):
        lengths = r.integers(1, spread, 5000)
        hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        configurations, bound = o9.plan(hist, 2048, 100)
        used = {}
        for times, items in configurations:
            assert sum(k * n for k, n in items) <= 2048
            for k, n in items:
                used[k] = used.get(k, 0) + times * n
        assert used == hist
        assert sum(t for t, _ in configurations) <= 1.03 * max(bound, lengths.sum() / 2048) + 3, spread


@pytest.mark.parametrize("most", [60, 400, 1500, 2047])
def test_plan_is_no_worse_than_best_fit(most):
    n, c = np.unique(np.random.default_rng(most).integers(1, most + 1, 20_000), return_counts=True)
    histogram = dict(zip(n.tolist(), c.tolist(), strict=True))
    plan, bound = o9.plan(histogram, 2048)
    total = np.zeros(2049, np.int64)
    total[n] = c
    used = sum(times for times, _ in plan)
    assert bound - 1e-6 <= used <= sum(times for times, _ in o9._best_fit(total, 2048))
    got = np.zeros(2049, np.int64)
    for times, items in plan:
        assert sum(k * m for k, m in items) <= 2048
        for k, m in items:
            got[k] += times * m
    assert (got[n] == c).all() and got.sum() == c.sum()


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_words_beside_marks_are_one_unit(name, kind):
    enc = units.UnitEncoder(public_tokenizers.path(name), kind)
    words = ["".join(w) for w in zip("abcdefghijklmnop" * 4, "éstuvwxyzéstuvwx" * 4, "aeiou" * 20, strict=False)]
    enc.encode([" " + "".join(f"{w}{m} {w}{m}{m}\n" for w in words for m in ",.;:!?)*")])
    assert len(enc.cache) <= 2 * len(set(words)) + 30


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_ids_of_many_texts_at_once(name, kind):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    enc = units.UnitEncoder(public_tokenizers.path(name), kind, most=500)
    r = random.Random(2)
    signs = ["a", "B", "é", "É", "×", " ", " ", "  ", "\n", "\t", "1", "23", ".", "'s", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "中", "　", "́", "İ", "\x1c", "\x85", "“"]
    some = [*ODD, None, *["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]]
    for end in (None, 7):
        for a in range(0, len(some), 700):
            ids, n = enc.ids(pa.array(some[a : a + 700], pa.string()), end)
            want = [t.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end]) for x in some[a : a + 700]]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_a_carry_goes_into_words_that_have_left():
    coder = mixcoder._Encoder(2, 8)
    for lane in (0, 1):  # words 5, 65535, 65535 and state 2 ** 64 - 1, in the first lane alone with a carry to come
        for i, word in enumerate((5, 65535, 65535)):
            coder.out[2 * i + lane] = word
        coder.at[lane] = 6 + lane
    coder.low[:] = ~np.uint64(0)
    coder.add(2, np.array([1, 0], np.uint64))
    assert coder.out.reshape(-1, 2)[:4].T.tolist() == [[6, 0, 0, 0], [5, 65535, 65535, 0]] and coder.low.tolist() == [0, (1 << 64) - 1]


@pytest.mark.parametrize("case", ["zero", "random"])
def test_any_changed_byte_of_a_block_is_found(case):
    ids = np.random.default_rng(3).integers(0, 1 if case == "zero" else 900, 2000).astype("<u4")
    image = mixcoder.encode(ids, block=512, lanes=4)
    body = len(image) - sum(np.frombuffer(image, "<u4", 8, 40 + int(np.frombuffer(image, "<u8", 1, 24)[0]))[::2].tolist())
    assert (mixcoder.decode(image) == ids).all()
    for i in sorted({*range(body, min(body + 24, len(image))), *range(max(body, len(image) - 24), len(image))}):
        broken = bytearray(image)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            mixcoder.decode(bytes(broken))


@pytest.mark.parametrize("rows", [0, 1, 256, 600])
def test_a_batch_is_tokenised_at_once_and_kept_in_blocks_of_256(rows, monkeypatch):
    import pyspark

    from veridune.llm import store

    class Counted(units.UnitEncoder):
        calls = 0

        def ids(self, *args):
            Counted.calls += 1
            return super().ids(*args)

        def encode(self, some):
            Counted.calls += 1
            return super().encode(some)

    path, size = public_tokenizers.path("word_bpe_49k.json"), 7
    monkeypatch.setattr(o9, "encoder", Counted)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Here", (), {"partitionId": lambda self: 3})()))
    some = [None if i % 50 == 9 else " ".join(["word, Word!"] * (i % 9)) for i in range(rows)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(some, pa.string())], names=["id", "text"])
    blocks = list(o9._pieces(path, size, 0)([batch]))
    assert Counted.calls <= 1 and len(blocks) == -(-rows // 256)
    assert [b["block"][0].as_py() for b in blocks] == [(3 << 32) | i for i in range(len(blocks))]
    t, want, got = Tokenizer.from_file(path), [], []
    for d, x in enumerate(some):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, p // size, p, len(ids[p : p + size]), zlib.crc32(ids[p : p + size].tobytes())) for p in range(0, len(ids), size)]
    for b in blocks:
        held = [tuple(r.values()) for r in store.load(b["payload"][0].as_buffer()).to_pylist()]
        got += held
        assert len({d for d, *_ in held}) <= 256
        n, c = np.unique([h[3] for h in held], return_counts=True)
        assert (b["lengths"][0].as_py(), b["counts"][0].as_py()) == (n.tolist(), c.tolist())
    assert got == want


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_units_held_are_found_together_and_not_encoded_again(name, kind, monkeypatch):
    enc = units.UnitEncoder(public_tokenizers.path(name), kind)
    asked = []
    monkeypatch.setattr(enc, "_encode", lambda some, f=enc._encode: asked.append(list(some)) or f(some))
    some = [*texts(), " " + "long" * 9, "x\u3000" + "longer" * 9]
    first = enc.encode(some)
    fresh = sum(map(len, asked))
    asked.clear()
    assert enc.encode(some) == first
    assert fresh > 1000 and 1000 * sum(map(len, asked)) < fresh  # but for those pushed out


@pytest.mark.parametrize("places", [1, 3, 22])
@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_crowded_places_and_units_alike(name, kind, places, monkeypatch):
    """Units that differ in their length, their last byte or a zero byte, at the lengths where keys end; few places, so that most are pushed out."""
    monkeypatch.setattr(units._Held, "PLACES", places)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    enc = units.UnitEncoder(public_tokenizers.path(name), kind, most=300)
    r = random.Random(5)
    some = ["a" * n + c for n in (0, 1, 6, 7, 8, 9, 14, 15, 16, 17, 21, 22, 23, 24, 25, 40) for c in ("", "b", "c", "\0", "\0\0", "é", "--", "'s")]
    some += ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for _ in range(3):
        r.shuffle(some)
        for text, ids in zip(some, enc.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        for text in some[:40]:
            assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
