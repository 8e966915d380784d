"""The pipeline's stages on small tables, and all of them against plain Python."""

import hashlib
from collections import Counter

import public_tokenizers

import corpus_pipeline
from loomspan.llm import bpe
from loomspan.llm.q_bpe import RANKS
from loomspan.llm.q_quality import production_model
from loomspan.llm.scratch import Scratch

from .test_lines_urls_mix import brute_targets, line_key
from .test_ngramjoin import brute

SMALL = "/root/testdata/sf0.001"


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark, "test-pipeline")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, folder), f"s{i}")
        assert docs.columns == (first.columns if i < 4 else ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]), name
        if i == 0:
            good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
            assert good.join(docs, "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert docs.count() == corpus_pipeline.run(spark, folder).count() > 0


def brute_pipeline(rows, good):
    """(doc_id, hash of the text) of every row of the mix; rows are (doc_id, source, text), ids differ; ``good`` holds the ids the classifier keeps."""
    rows = [r for r in rows if r[0] in good]
    held = {}
    for d, _, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10:
                held.setdefault(line_key(line), set()).add(d)
    stays = lambda d, line: len(held.get(line_key(line), ())) < 2 or d == min(held[line_key(line)])
    rows = [(d, s, None if t is None else "\n".join(x for x in t.split("\n") if stays(d, x))) for d, s, t in rows]
    component = {d: c for d, _, c in brute([(d, t) for d, _, t in rows])[0]}
    rows = [r for r in rows if component[r[0]] == r[0]]
    sizes = {}
    words = lambda t: len((t or "").encode().split())
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    target = brute_targets(sizes, {s: i % 3 + 1.0 for i, s in enumerate(order)})
    out = Counter()
    for s in order:
        offset = 0
        for _, d, t in sorted((hashlib.md5(f"{d}\n{t or ''}".encode()).hexdigest(), d, t) for d, x, t in rows if x == s):
            n = words(t)
            out[d, hashlib.sha256((t or "").encode()).hexdigest()] += sum(n > 0 and offset + r * sizes[s] + n / 2 < target[s] for r in range(3))
            offset += n
    return +out


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = production_model(spark, docs, SMALL)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    good = {d for (d, _, _), x in zip(rows, model.score([t for _, _, t in rows])) if x >= 0.5}
    want = brute_pipeline(rows, good)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    codec = bpe.codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for r in got[:50]:
        assert hashlib.sha256(codec.decode(__import__("numpy").array(r.ids, "u4"))).hexdigest() == r.decoded_sha256


def folder_of(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, draw string, part int, n int"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, a very long text and columns with the names that operators use."""
    plain = "A plain sentence of this text stands here, and others follow it in good order."
    texts = [None, "", plain, plain, plain + " And one more.", " ".join(f"word{i}" for i in range(40_000)), "\n".join([plain] * 3)]
    rows = [(i % 5 if i != 6 else None, t, None, ("a", None)[i % 2], len(t or ""), "d", 1, i) for i, t in enumerate(texts)]
    folder = folder_of(spark, tmp_path / "odd", rows + rows[2:3] * 2)
    scratch, docs = Scratch(spark, "test-odd"), spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, folder), f"s{i}")
        assert i == 4 or docs.columns == names, name
    assert docs.where("n_tokens > 0").count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "none", [])).collect() == []
