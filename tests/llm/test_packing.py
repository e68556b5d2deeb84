import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "aB'sTéÉß İıΣςσ \n\t\x0b\x1c\x85\xa0²½٣1２.,!<|>%endoftextÅǺ‍ﬁǅ한中😀’'re'll'd \xadͅẞªµ_"


def ids(text):
    return packing.encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_tokenizer():
    r = random.Random(1)
    texts = ["", "\n\n ", "x" * 5000, "it's I'll 'stop don''t", "<|endoftext|> a", "　１２ ﬁ"]
    texts += ["".join(r.choices(SIGNS, k=r.randint(1, 40))) for _ in range(3000)]
    model = packing.encoder(PATH)
    assert model.known
    for t in texts:
        assert model.encode(t) == np.asarray(ids(t), dtype="<u4").tobytes(), t


def test_full_caches_and_other_vocabularies_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED", 3)
    model = packing.Encoder(PATH)
    text = "some words, Some words again; and others"
    assert model.encode(text) == model.encode(text) == np.asarray(ids(text), dtype="<u4").tobytes()
    other = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.known
    assert other.encode("a  b") == np.asarray(other.tokenizer.encode("a  b", add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a few words"), (2, None), (3, ""), (4, "word " * 5000), (None, "no id"), (5, "same"), (5, "same"), (6, "한국 " * 700)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"offset": F.lit("x"), "length": F.lit("y"), "__group": F.lit(1)})


def test_pieces_and_places(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for doc, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        want = [*ids(text or ""), 0]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc})
        cut = [want[k : k + 2048] for k in range(0, len(want), 2048)]
        assert own == [(k, 2048 * k, len(c), zlib.crc32(np.asarray(c, dtype="<u4").tobytes())) for k, c in enumerate(cut)]
    assert sum(r["doc_id"] == 5 for r in rows) == 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_close_to_the_bound():
    lengths = np.random.default_rng(2).integers(1, 1500, 4000)
    assert packing.best_fit(lengths, packing.Capacity()).max() + 1 <= 1.005 * np.ceil(lengths.sum() / 2048)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.random.default_rng(3).integers(1, 400, 500)
    capacity = packing.Capacity(2048, documents=9, attention=400_000.0, score=score)
    bins = packing.best_fit(lengths, capacity)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert 0 < len(own) <= 9 and own.sum() <= 2048 and (own.astype(float) ** 2).sum() <= 400_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([700]), capacity)


def test_attention_capacity_cuts_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 1000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, packing.Capacity(attention=250_000.0)).collect()
    assert max(r["length"] for r in rows) == 500 and len({r["sequence_id"] for r in rows}) == len(rows)


def test_groups_are_independent_of_ids(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 60, "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, packing.Capacity(group=10)).collect()
    assert len(rows) == 60 and len({r["sequence_id"] >> 32 for r in rows}) > 1


def test_senseless_capacities():
    for bad in ({"tokens": 0}, {"documents": -1}, {"score": "worst"}, {"group": 0}):
        with pytest.raises(ValueError):
            packing.Capacity(**bad)


def test_ids_are_those_of_a_tokenizer_as_it_comes():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["hello <|startoftext|> world", "<|endoftext|>", "a<|ENDOFTEXT|>b", "x <|endoftext|", "<|startoftext|><|endoftext|> é <|endoftext|>", "no such thing"]
    for t in texts:
        assert packing.encoder(PATH).encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t
    assert packing.encoder(PATH).encode(texts[0]) == np.asarray([3306, 49406, 1002], dtype="<u4").tobytes()


def test_any_internal_name_may_be_a_column(spark):
    pieces = spark.createDataFrame([(5, 1, 2, 3), (6, 1, 2, 3)], "length long, __group int, group int, _group int")
    rows = packing.pack(pieces).collect()
    assert {(r["__group"], r["group"], r["_group"]) for r in rows} == {(1, 2, 3)} and sorted(r["offset"] for r in rows) in ([0, 5], [0, 6])
