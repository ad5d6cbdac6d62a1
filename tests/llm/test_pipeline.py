"""The pipeline on the smallest table, stage by stage against brute force."""

import hashlib
import zlib

import numpy as np

import corpus_pipeline
from brindle.llm import tokens, toxicity
from brindle.llm.common import fresh_path, table
from brindle.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_classes, brute_contamination, brute_fingerprint

SF = "/root/testdata/sf0.001"


def written(spark, df, name):
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def test_edges(spark, tmp_path):
    """An empty table, nulls in every column, repeated rows and names that operators use themselves."""
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, bits string, rate string, hits string"
    rows = [(1, text, "en", "s", 1, "b", "r", "h"), (1, text, "en", "s", 1, "b", "r", "h"), (None, None, None, None, None, None, None, None), (4, "", None, None, None, None, None, None)]
    for given, want in (([], set()), (rows, {(1, 60), (4, 0)})):
        docs = spark.createDataFrame(given, kinds)
        columns = docs.columns
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = written(spark, function(spark, docs, str(tmp_path)), name)
            assert docs.columns == columns
            left = [(r.doc_id, len((r.text or "").split())) for r in docs.collect()]
            assert (len(left), set(left)) == (len(want), want) if name in ("simhash", "decontaminate") else set(left) <= want | {(None, 0)}
        got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(got) == docs.count() and all(r.n_tokens == 1 for r in got if r.doc_id == 4)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, {}
    held["documents"] = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = written(spark, function(spark, docs, SF), name)
        assert docs.columns == columns
        held[name] = {r.doc_id: r.text for r in docs.collect()}
    names = ["documents", *[n for n, _ in corpus_pipeline.STAGES[:-1]]]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert set(held["toxicity"]) == {i for i, t in held["documents"].items() if model.score((t or "").encode()) < 0.5}
    for a, b in zip(names, names[1:], strict=False):
        assert held[b].items() <= held[a].items()
    prints = {i: brute_fingerprint(t) for i, t in held["toxicity"].items()}
    assert set(held["simhash"]) == set(brute_classes(sorted(prints), prints).values())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(held["decontaminate"]) == {i for i, t in held["simhash"].items() if not brute_contamination(t, items)[-1]}
    got = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r.doc_id)
    enc, start = tokens.Encoder(tokenizer_path()), 0
    for r in got:
        ids = [*enc.whole.encode(held["mixing"][r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id for r in got} == set(held["mixing"])
    assert hashlib and corpus_pipeline.ORACLE_SQL is None
