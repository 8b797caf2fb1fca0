import random

import numpy as np
import public_tokenizers
import sentencepiece

from tests.llm import oracle
from veridune.llm import op02_topk as o2
from veridune.llm import op04_secret_scan as o4
from veridune.llm import op07_sentencepiece as o7


def test_topk_sql(spark):
    assert oracle.rows(o2.op2_exact_topk(spark, oracle.SF)) == oracle.run(o2.SQL)


def test_topk_cases(spark, monkeypatch):
    monkeypatch.setattr(o2, "CHUNK", 4)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 5) / 8]) for i in range(230)]
    rows += [(231, None), (240, [1.0, None, 0.0, 0.0, 0.0]), (260, [float("nan")] * 5), (261, [float("inf")] * 5), (280, []), (None, [9.0] * 5), (300, [0.5, 0.25]), (400, [0.1] * 5)]
    got = o2.top_k(spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, score string").repartition(4), k=7).collect()
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (5 - len(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:7]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert o2.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_forest_on_held_out_findings():
    findings = o4.generated_findings(3000, 5)
    model = o4.train(o4.generated_findings(2000, 1), trees=20)
    p = model.predict(np.array([o4.features(*f[:4]) for f in findings])) >= 0.5
    y = np.array([f[4] for f in findings], bool)
    assert (p & y).sum() / p.sum() > 0.9 and (p & y).sum() / y.sum() > 0.9


def test_secret_scan(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'é the token = "{key}" in text', "src1", 1), (2, "plain words only", "src2", 2), (3, None, None, 3), (4, "", "", 4), (None, f'token = "{key}"', "src1", 5), (5, "see commit-message-about-index-2024 here", "docs", 6), (1, f'é the token = "{key}" in text', "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = sorted(((r.doc_id or -1, r.start, r.end) for r in o4.secret_scan(docs).collect()))
    assert got == [(-1, 9, 49), (1, 16, 56), (1, 16, 56)]
    clean = o4.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect())[-2:] == [(4, ""), (5, rows[5][1])]
    assert all(key not in (r.text or "") for r in clean.collect()) and clean.where("text like '%[SECRET]%'").count() == 3
    assert o4.secret_scan(docs.limit(0)).collect() == []
    table = spark.createDataFrame([(t.decode(), a, b, p, bool(y)) for t, a, b, p, y in o4.generated_findings(600, 3)], "text string, start int, end int, path string, is_secret boolean")
    assert o4.secret_scan(docs, findings=table).count() >= 3


def test_every_planted_token_is_found(spark):
    docs = spark.read.parquet(f"{oracle.SF}/../sf0.01/documents.parquet")
    planted = docs.selectExpr("doc_id", "explode(regexp_extract_all(text, 'token = \"([0-9a-f]{40})\"', 1)) as k").groupBy("doc_id").count()
    found = o4.secret_scan(docs).groupBy("doc_id").count().withColumnRenamed("count", "n")
    joined = planted.join(found, "doc_id", "left").collect()
    assert len(joined) > 5 and all((r.n or 0) >= r["count"] for r in joined)


def test_pieces_are_those_of_the_library(spark):
    import duckdb

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = ["", " ", "  a", "a  b ", "a\n b\tc", "日本語 \U0001f600 é", "▁x ▁", "aaaaaaaaaaaaaaaaaaaaa", "        deep", "x" * 300] + ["".join(r.choice("ab ée\nThing1") for _ in range(60)) for _ in range(300)]
    texts += [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    got = o7.PieceModel(path).encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<i4").tolist() == sp.encode(t), repr(t[:60])
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(None, None, None)]
    enc = o7.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3))
    back = {r.doc_id: r.text for r in o7.decode(enc).collect()}
    assert back == {i: (sp.decode(sp.encode(t or "")) if t else "") for i, t, _ in rows}
    assert o7.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unigram_tables_are_the_best_sums():
    m = o7.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    m.unigram, m.id = True, {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "bb"])}
    m.score, m.longest = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -2.9, "aba": -4.6, "bb": -3.3}, 3
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(i % 9 + 1)) for i in range(80)})

    def best(w):
        return max(((m.score[w[:k]] + best(w[k:])) for k in range(1, min(3, len(w)) + 1) if w[:k] in m.score), default=-1e9) if w else 0.0

    for w, parts in zip(words, m.encode_sorted(words), strict=True):
        assert "".join(parts) == w and abs(sum(m.score[p] for p in parts) - best(w)) < 1e-9
