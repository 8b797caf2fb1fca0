"""Every registered query on a small table of awkward rows, against its contract by brute force; operators beside columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from veridune.llm import op03_simhash, op04_secret_scan, op06_quality_rules, op10_line_dedup, registry
from veridune.llm.units import default_path

CLASH = "__t __stratum __text __clean __stay id row node key n block bucket line rank __id hash doc keys count features piece length __features label path".split()


def texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    shared = " ".join(word() for _ in range(60))
    own = lambda n: " ".join(word() for _ in range(n))
    long = own(4000)
    return [
        (3, f"{own(20)}\n{shared}\n{own(20)}"), (1, None), (2, ""), (4, " \n\t "), (9, f"{shared} {own(8)}"), (5, f"{own(5)} {shared}"), (7, long), (8, f"{long} {own(2)}"),
        (6, "x" * 70_000 + " token=9f86d081884c7d659a2feaa0c55ad015"), (10, own(2)), (11, own(30)), (12, "Café ÅB " + own(12)),
    ]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    kind = "doc_id long, text string, source string, lang string, n_chars long"
    spark.createDataFrame([(d, t, "s", "en", len(t or "")) for d, t in texts()], kind).repartition(3).write.parquet(str(root / "documents.parquet"))
    return str(root)


def run(spark, sf, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}


def repeats(units, length):
    """Per document in id order: a flag a unit, covered by a window that starts in a smaller document."""
    seen, out = set(), {}
    for d in sorted(units):
        u, here = units[d], []
        flags = [False] * len(u)
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length]
            here.append(w)
            if w in seen:
                flags[i : i + length] = [True] * length
        seen.update(here)
        out[d] = flags
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark, sf):
    raw = {d: (t or "").encode() for d, t in texts()}
    got = run(spark, sf, "op1_suffix_array_dedup")
    gone = repeats(raw, 50)
    assert sum(map(sum, gone.values())) > 20_000
    for d, b in raw.items():
        spans = sum(1 for i, g in enumerate(gone[d]) if g and (i == 0 or not gone[d][i - 1]))
        want = (len(b), sum(gone[d]), spans, sha(bytes(x for x, g in zip(b, gone[d], strict=True) if not g)))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == want, d


def test_op5(spark, sf):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts()}
    got = run(spark, sf, "op5_substring_dedup")
    gone = repeats(words, 13)
    for d, w in words.items():
        kept = " ".join(x for x, g in zip(w, gone[d], strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone[d]), sha(kept.encode())), d


def test_op3(spark, sf):
    def mark(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {d: mark(t) for d, t in texts()}
    least = {d: d for d in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    got = run(spark, sf, "op3_simhash_near_dedup")
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp[d]:016x}", least[d]) for d in fp}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op8(spark, sf):
    tok, at, want = Tokenizer.from_file(default_path("byte_bpe_50k.json")), 0, {}
    for d, t in sorted(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {d: (r.start, r.n_tokens, r.ids_crc32) for d, r in run(spark, sf, "op8_token_files").items()} == want


def test_op9(spark, sf):
    tok, want = Tokenizer.from_file(default_path("word_bpe_49k.json")), []
    for d, t in texts():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, i // 2048, i, len(ids[i : i + 2048]), crc(ids[i : i + 2048])) for i in range(0, len(ids), 2048)]
    got = registry.QUERIES["op9_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for pieces in of.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_op4_and_op7(spark, sf):
    found = registry.QUERIES["op4_secret_scan"](spark, sf).collect()
    assert {r.doc_id for r in found} == {6}
    assert sorted(run(spark, sf, "op7_sentencepiece")) == list(range(1, 13))


def test_columns_of_clashing_names_come_back(spark):
    kind = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH)
    rows = [(d, t, "en", *["v"] * len(CLASH)) for d, t in [*texts(), (None, None), (3, "again")]]
    df = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for op in (lambda d: op06_quality_rules.quality_filter(d, labels), op10_line_dedup.drop_common_lines, op03_simhash.keep_one, op04_secret_scan.redact):
        out = op(df)
        assert sorted(out.columns) == sorted(df.columns)
        assert all(r[c] == "v" for r in out.collect() for c in CLASH)
