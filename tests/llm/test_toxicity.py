import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oscilla.llm import toxicity

BAD = ["grumblefoot", "snarkwit", "vexhead"]


def text(r, bad):
    w = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(r.randint(30, 150))]
    for _ in range(r.randint(1, 4) if bad else 0):
        w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", "s", ",", "ing"])
    return " ".join(w)


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return toxicity.train([text(r, True) for _ in range(80)], [text(r, False) for _ in range(300)])


def test_new_texts_are_told_apart(model):
    r = random.Random(2)
    scorer = toxicity.Scorer(model)
    bad, good = ([scorer.score(text(r, k)) >= 0.3 for _ in range(100)] for k in (True, False))
    assert sum(bad) >= 95 and sum(good) <= 5


def test_windows_are_the_whole_text():
    r = random.Random(3)
    for body in (b"", b"x" * 1000, " é".encode() * 300, text(r, False).encode() * 5):
        parts = list(toxicity.windows(body))
        joined = parts[0] if parts else b""
        for p in parts[1:]:
            joined += p[1:]
        assert joined == body


def test_toxic_words_at_the_end_of_a_very_long_text_count(model):
    r = random.Random(4)
    long = " ".join(text(r, False) for _ in range(60))
    scorer = toxicity.Scorer(model)
    assert scorer.score(long + " " + " ".join(f"{b} and" for b in BAD * 12)) > scorer.score(long)


def test_held_out_accuracy_on_the_tables():
    base = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{base}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{base}/labels.parquet").to_pylist()}
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    train = [i for i in labels if i not in held]
    toxic = [docs[i] for i in train if labels[i] == 1]
    plain = [docs[i] for i in train if labels[i] == 0][:2000]
    scorer = toxicity.Scorer(toxicity.train(toxic, plain, len(toxic) / len(train)))
    hit = [scorer.score(docs[i]) >= 0.3 for i in held if labels[i] == 1]
    wrong = [scorer.score(docs[i]) >= 0.3 for i in held if labels[i] == 0]
    assert sum(hit) > 0.75 * len(hit) and sum(wrong) < 0.05 * len(wrong)


def test_copies_are_one_piece_of_evidence():
    r = random.Random(5)
    one = text(r, False)
    assert toxicity._distinct([one, one, one + " tail"]) == [one]
    assert len(toxicity._distinct([text(r, False) for _ in range(20)])) == 20


def test_frames(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    found = toxicity.fit(docs, labels)
    # Ids, labels, languages and sources are no inputs of a score.
    other = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(1).alias("score"))
    a = sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, found).collect())
    b = sorted((r["doc_id"] - 1_000_000, r["score"]) for r in toxicity.score(other, found).collect())
    assert a == b and all(0 <= s <= 1 for _, s in a)
    kept = toxicity.drop_toxic(docs, found)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in a if s < 0.3}


def test_held_out_rows_never_change_the_model(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.fit(docs, none)
    rows = toxicity.score(docs, found).collect()
    assert len(rows) == 4 and all(r["score"] < 0.01 for r in rows)
    assert toxicity.drop_toxic(docs, found).count() == 4
    assert toxicity.score(docs.limit(0), found).count() == 0


@pytest.mark.parametrize("rows", [100, 323, 2000])
def test_held_out_accuracy_by_way_of_fit(spark, rows):
    """Fewer toxic rows than there are, as many, and more: the sample's ratio of classes decides nothing."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.fit(docs, labels, rows=rows))
    held = docs.join(labels, "doc_id").where(toxicity.held_out() & F.col("toxic").isin(0, 1)).select("text", "toxic").collect()
    hit = [scorer.score(r["text"] or "") >= 0.3 for r in held if r["toxic"] == 1]
    wrong = [scorer.score(r["text"] or "") >= 0.3 for r in held if r["toxic"] == 0]
    assert sum(hit) > (0.55 if rows == 100 else 0.75) * len(hit) and sum(wrong) < 0.05 * len(wrong)


def test_as_many_ordinary_rows_as_toxic_ones():
    r = random.Random(8)
    scorer = toxicity.Scorer(toxicity.train([text(r, True) for _ in range(100)], [text(r, False) for _ in range(100)]))
    bad, good = ([scorer.score(text(r, k)) >= 0.3 for _ in range(100)] for k in (True, False))
    assert sum(bad) >= 90 and sum(good) <= 10


def test_without_telling_passages_the_dictionaries_are_those_of_the_texts():
    r = random.Random(9)
    found = toxicity.train([text(r, False) for _ in range(12)], [text(r, False) for _ in range(40)])
    assert found.toxic.strip(b"\0 ") != found.ordinary.strip(b"\0 ")
    assert 0 <= toxicity.Scorer(found).score(text(r, False)) <= 1


def test_windows_for_training_come_from_all_texts():
    texts = [f"text{k} " * 100 for k in range(50)]
    some = b"".join(toxicity._some_windows(texts, 60))
    assert all(f"text{k} ".encode() in some for k in range(50))


def test_short_and_very_long_words_are_evidence():
    r = random.Random(10)

    def one(bad):
        return f"{text(r, False)} {r.choice(['zqx', 'w' + 'aeiou' * 30]) if bad else 'and'} {text(r, False)}"

    scorer = toxicity.Scorer(toxicity.train([one(True) for _ in range(120)], [one(False) for _ in range(400)]))
    assert sum(scorer.score(one(True)) >= 0.3 for _ in range(50)) >= 40  # the compressor may step over so short a match
    assert sum(scorer.score(one(False)) >= 0.3 for _ in range(50)) <= 3


def test_ties_and_clashing_columns(spark, model):
    r = random.Random(11)
    one = text(r, True)
    docs = spark.createDataFrame([(1, one, 0.0, 1, b"x")] * 3, "doc_id long, text string, score double, toxic int, __row binary")
    scores = {x["score"] for x in toxicity.score(docs, model).collect()}
    assert len(scores) == 1
    at = scores.pop()
    assert toxicity.drop_toxic(docs, model, at).count() == 0 and toxicity.drop_toxic(docs, model, at + 1e-9).collect() == docs.collect()
