import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import oracle
from veridune.llm import op07_sentencepiece as o7


def test_query_decodes_every_document(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()
    want = spark.createDataFrame([(r.doc_id, sp.decode(sp.encode(r.text or "")) if r.text else "") for r in docs], "doc_id long, t string")
    want = want.select("doc_id", F.xxhash64("t").alias("h"))
    got = o7.op7_sentencepiece(spark, oracle.SF).select("doc_id", "decoded_hash")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(docs) > 100


def test_lists_are_decoded_like_single_ones():
    m = o7.model(None)
    texts = ["", " ", "a", "  two words\n", "é 日本語 \U0001f600 x", "▁ mark", "long " * 50_000, "z" * 100_000]
    lists = [np.frombuffer(x, "<i4").tolist() for x in m.encode(texts)]
    lists += [[], [m.byte[0xE2], m.byte[0x96], m.byte[0x81]], [m.byte[0xFF], m.byte[0x20]], [m.unknown, m.unknown], [m.byte[0x0A]]]
    ends = np.cumsum([0, *map(len, lists)])
    assert m.decode_lists(np.concatenate([np.zeros(0, np.int32), *[np.array(x, np.int32) for x in lists]]), ends).to_pylist() == [m.decode(x) for x in lists]
    assert m.decode_lists(np.zeros(0, np.int32), np.array([0, 0, 0])).to_pylist() == ["", ""]
