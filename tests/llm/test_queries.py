"""The registered corpus queries: contracts, twins, and the pipeline against its stages done by hand."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle import agree, connect
from oscilla.llm import decontam, exact, minhash, packing, queries, toxicity

COLUMNS = {
    "op1_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_": ["page_id", "host", "path", "rule", "verdict"],
    "op3_": ["doc_id", "item_id"],
    "op4_": ["page_id", "url", "text", "n_chars"],
    "op5_": ["doc_id", "expected_grade", "tail_probability", "kept"],
    "op6_": ["doc_id", "license"],
    "op7_": ["doc_id", "class_id", "class_size", "kept"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op9_": ["doc_id", "score"],
    "op10_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert len(names) == 10 and {re.match(r"op\d+_", n)[0] for n in names} == set(COLUMNS)
    assert "pipeline" in entry.queries() and entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_twins(spark, small, name):
    found = queries.QUERIES[name](spark, small)
    assert set(COLUMNS[re.match(r"op\d+_", name)[0]]) <= set(found.columns)
    if name in queries.ORACLE_SQL:
        agree(found, connect(small), queries.ORACLE_SQL[name])
    else:
        assert found.count() > 0


def test_pipeline_is_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    left = {i for i, t in texts.items() if scorer.score(t) < 0.3}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    left = sorted(first.values())
    bags = {i: minhash.multiset(texts[i]) for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in left:
        for b in left:
            if a < b and find(a) != find(b) and minhash.overlap(bags[a], bags[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    left = [i for i in left if find(i) == i]
    block = decontam.Block([(r["item_id"], r["text"]) for r in benchmark.collect()])
    left = {i for i in left if not block.leaks(texts[i])}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == left
    tokens = {i: len(packing.encoder(queries.vocabulary("word_bpe_49k.json")).encode(texts[i])) // 4 + 1 for i in left}
    for i in left:
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == tokens[i]


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    assert exact.drop_exact(docs).count() < docs.count()


def test_stages_take_empty_input(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0
