"""The pipeline against plain Python over the same rows."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies import brute
from veridune.llm import op04_secret_scan as o4
from veridune.llm import op06_quality_rules as o6

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(spark, path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(120):
        t = "\n".join(" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(r.randint(1, 6)))
        if i % 5 == 0:
            t += "\nAll rights are reserved by the owners of this very long line"
        if i % 7 == 0 and rows:
            t = rows[-1][1] + " x"
        if i % 11 == 0:
            t += '\ntoken = "' + "%040x" % r.getrandbits(160) + '"'
        if i % 13 == 0:
            t = "few words"
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
    rows += [(500, None, None, None, None), (501, "", "en", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in o6.judge(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where("__quality.kept").collect()}
    docs = {d: t for d, t, *_ in rows if d in kept}
    assert 20 < len(docs) < len(rows)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    count, top = {}, {}
    for d, t in docs.items():
        for k in {key(s) for s in t.split("\n") if len(key(s)) >= 40}:
            count[k] = count.get(k, 0) + 1
            top[k] = max(top.get(k, -1), d)
    docs = {d: "\n".join(s for s in t.split("\n") if count.get(key(s), 0) < 5 or top[key(s)] == d) for d, t in docs.items()}
    docs = dict(brute(list(docs.items())))
    model = o4.model_from()
    source = {d: s for d, _, _, s, _ in rows}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in docs.items():
        b = t.encode()
        for a, e, _ in reversed(o4._judge(b, source[d], model, 0.5)):
            b = b[:a] + b"[SECRET]" + b[e:]
        ids = np.array([*tok.encode(b.decode(), add_special_tokens=False).ids, 0], "<u4")
        want += [(d, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, str(tmp_path)).dtypes) == sorted(docs.dtypes)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
