"""The pipeline against a plain Python version of its stages."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from tessera.llm import bpe, toxicity
from tests.llm.test_dedup_join import brute_classes
from tests.llm.test_text_ops import plain_bpe, plain_mix


def test_pipeline_matches_plain(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if toxicity.scores(pa.array([r[1]]), model)[0] < 0.5]
    best = {}
    for r in rows:
        key = "".join(r[1].split(" ")).translate({c: None for c in range(9, 14)})
        best[key] = min(best.get(key, (1, 0, None)), (-len(r[1]), r[0], r))
    rows = [r for _, _, r in best.values()]
    stay = {i for i, _, c in brute_classes([r[:2] for r in rows], 5, 80, 100) if i == c}
    rows = [r for r in rows if r[0] in stay]
    kept = {i for i, _, k in plain_mix(rows)[0] if k}
    rows = [r[:2] for r in rows if str(r[0]) in kept]
    got = corpus_pipeline.run(spark, d).collect()
    from collections import Counter

    assert Counter(map(tuple, got)) == plain_bpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), rows)
    assert 50 < len(got) < 200


def test_stages_keep_columns_and_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0, name
