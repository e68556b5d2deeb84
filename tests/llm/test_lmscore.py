import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oscilla.llm import lmscore, minhash

ROWS = [(1, "the cat sat on the mat."), (2, "the cat ate"), (3, None), (4, "buy now buy now buy now"), (4, "buy now buy now buy now"), (None, "the mat"), (5, "")]
SHAPE = lmscore.Shape(words=1 << 18, pairs=1 << 21, strength=5.0)


def brute(rows, target):
    """Dictionaries in place of slots: the same models without collisions."""
    tokens = [lmscore._WORD.findall((t or "").lower()) for _, t in rows]
    word, pair = [Counter(), Counter()], [Counter(), Counter()]
    for (d, _), ts in zip(rows, tokens, strict=True):
        for m in (0, 1) if d in target else (0,):
            word[m].update(ts)
            pair[m].update(zip([None, *ts], ts, strict=False))
    if word[1]:
        scale = sum(word[1].values()) / sum(word[0].values())
        word[0], pair[0] = ({k: v * scale for k, v in c.items()} for c in (word[0], pair[0]))
    word, pair = ([defaultdict(float, c) for c in m] for m in (word, pair))
    out = []
    for (d, _), ts in zip(rows, tokens, strict=True):
        loss = [0.0, 0.0]
        for m in (0, 1):
            total = sum(word[m].values())
            for before, w in zip([None, *ts], ts, strict=False):
                alone = (word[m][w] + 1) / (total + SHAPE.words)
                n = word[m][before] if before is not None else 0
                loss[m] -= math.log((min(pair[m][before, w], n) + SHAPE.strength * alone) / (n + SHAPE.strength)) / len(ts)
        out.append((d, len(ts), *loss))
    return sorted(out, key=str)


@pytest.mark.parametrize("target", [{1, 2}, set(), {1, 2, 3, 4, 5}])
def test_against_brute_force(spark, target):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"seen": F.lit(1), "wanted": F.lit("x"), "slot": F.lit(2)})
    wanted = spark.createDataFrame([(t,) for t in target] * 2, "doc_id long")
    got = sorted([(r["doc_id"], r["n_words"], r["background_loss"], r["target_loss"]) for r in lmscore.score(docs, wanted, SHAPE).collect()], key=str)
    for a, b in zip(got, brute(ROWS, target), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-4)


def test_target_like_text_scores_higher(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, spark.createDataFrame([(1,), (2,)], "doc_id long"), SHAPE).collect()}
    assert got[2] > 0 > got[4] and got[5] == 0.0


def test_counts_cover_every_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    total = lmscore.counts(docs, docs.limit(0).select("doc_id")).agg(F.sum("seen"), F.sum("wanted")).first()
    want = sum(len(lmscore._WORD.findall((r["text"] or "").lower())) for r in docs.collect())
    assert (total[0], total[1]) == (2 * want, 0)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lmscore.score(none, none.select("doc_id")).count() == 0


def test_every_pair_is_counted_apart_however_many_there_are(spark):
    """400 documents of 40 words of their own: with more pairs than slots or tasks hold, losses are as of dictionaries."""
    rows = [(d, " ".join(f"w{(d * 7919 + k * k * 31) % 5000}" for k in range(40))) for d in range(400)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(d,) for d in range(0, 400, 3)], "doc_id long")
    shape = lmscore.Shape(words=SHAPE.words, pairs=1 << 8, strength=SHAPE.strength)
    got = sorted([(r["doc_id"], r["n_words"], r["background_loss"], r["target_loss"]) for r in lmscore.score(docs, wanted, shape).collect()], key=str)
    for a, b in zip(got, brute(rows, set(range(0, 400, 3))), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6)


@pytest.mark.parametrize("share", [1, 50, 1 << 14])
@pytest.mark.parametrize("pairs", [64, 1 << 21])
def test_common_or_not_on_one_task_or_many_the_losses_are_the_same(spark, monkeypatch, share, pairs):
    """Hot words and pairs, a very long text and a word of its own at a text's end, in every division of the work."""
    words = ["the", "the", "the", "of", "of", "and", *(f"x{k}" for k in range(60))]
    rows = [(d, " ".join(words[(d * 31 + k * k * 7 + k // 3) % len(words)] for k in range(25)) + f" own{d % 7}") for d in range(60)]
    rows += [(100, "the of " * 3000), (101, "solo"), (102, None), (102, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(d,) for d in range(0, 120, 3)], "doc_id long")
    docs = spark.createDataFrame(docs.collect(), "doc_id long, text string")
    monkeypatch.setattr(lmscore, "SAMPLE", 20 if share == 50 else 10_000)
    monkeypatch.setattr(lmscore, "_TASKS", 3 if share == 50 else 1 << 16)
    shape = lmscore.Shape(words=SHAPE.words, pairs=pairs, strength=SHAPE.strength, share=share)
    got = sorted([(r["doc_id"], r["n_words"], r["background_loss"], r["target_loss"]) for r in lmscore.score(docs, wanted, shape).collect()], key=str)
    for a, b in zip(got, brute(rows, set(range(0, 120, 3))), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6)


def test_words_are_those_of_the_whole_text():
    import numpy as np

    parts = lmscore._Parts(np.zeros(0, dtype=np.uint64))
    for text in ("", " ", "a  b", "A.b,c\nd\te f", "ΟΔΟΣ ΟΔΟΣ. x_y 1,000", "ß ÉÉ  –"):
        want = minhash.word_hashes(lmscore._WORD.findall(text.lower()))
        assert parts.of(text).tolist() == want.tolist()
    common = np.sort(minhash.word_hashes(["b", "the"]))
    assert lmscore._Parts(common).of("The x b.").tolist() == [int(np.searchsorted(common, h)) if h in common else int(h) for h in minhash.word_hashes(["the", "x", "b", "."])]
    assert int.from_bytes(lmscore._digest("x"), "big") >= lmscore._RARE
