import hashlib
import random

import numpy as np
import public_tokenizers as P

from loomspan.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(3)
    alphabet = "abc  \n\t'sé汉字12!?_-"
    return ["", None, " ", "it's", "a" * 400, " \n  \n" * 200, "x'" * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(900))) for _ in range(60)]


def test_chunked_encoding_is_whole_text_encoding(spark, monkeypatch):
    monkeypatch.setattr(bpe, "OVERLAP_CHARS", 40)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts())], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, P.PATTERN, chunk_chars=100).collect()}
    enc = bpe.codec(RANKS, P.PATTERN).encoding
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        want = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_stitching_matches_at_every_chunk_size():
    c = bpe.codec(RANKS, P.PATTERN)
    for text in texts():
        if not text:
            continue
        for core in (7, 33, 150):
            chunks = []
            for s in range(0, len(text), core):
                part = text[s : s + core + bpe.OVERLAP_CHARS]
                cut, zone, counts, ids = bpe.chunk_cut(c, part, core)
                chunks.append({"core": part[:core], "cut": cut, "zone": np.array(zone), "counts": np.array(counts), "ids": ids})
            assert bpe.stitch(c, chunks).tolist() == c.encoding.encode_ordinary(text)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "word " * 50), (1, "word " * 50), (None, "b " * 60), (1, "other")], "doc_id long, text string")
    got = bpe.encode_documents(docs, RANKS, P.PATTERN, chunk_chars=100).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None"]


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).collect() == []
