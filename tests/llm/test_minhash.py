import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from oscilla.llm import minhash


def words(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def bag(text):
    w = minhash._WORD.findall(text.lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    a, b = bag(a), bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and similarity(texts[i], texts[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus(seed=1):
    r = random.Random(seed)
    texts = []
    for _ in range(25):
        base = words(r, r.choice((3, 12, 60, 200)))
        for _ in range(r.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 2, len(base) // 8))):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            texts.append(" ".join(copy))
    return [*texts, "", "...", "one two", "One  TWO!", "the same " * 50, "the same " * 51, "the same " * 90]


def test_signatures_are_unbiased_and_sharp():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a = rng.integers(1, 9, len(keys))
        b = np.where(rng.random(len(keys)) < 0.3, rng.integers(1, 20, len(keys)), a)
        s = minhash.signatures(np.r_[keys, keys], np.r_[a, b], np.repeat([0, 1], len(keys)), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 2**63, 700).astype(np.uint64), rng.integers(1, 5, 700)
    docs = np.sort(rng.integers(0, 7, 700))
    together = minhash.signatures(keys, counts, docs, 7)
    for d in range(7):
        own = docs == d
        assert (minhash.signatures(keys[own], counts[own], np.zeros(own.sum(), int), 1)[0] == together[d]).all()


def test_bands_find_what_is_near():
    """At similarity 0.8 a pair of 32 bands of four is missed once in ten million pairs."""
    assert (1 - 0.8**minhash.ROWS) ** (minhash.REGISTERS // minhash.ROWS) < 1e-7


def test_overlap_is_exact():
    texts = corpus()
    for a, b in zip(texts, texts[1:], strict=False):
        assert abs(minhash.overlap(minhash.multiset(a), minhash.multiset(b)) - similarity(a, b)) < 1e-12


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (10, 8), (20, 21), (21, 20), (6, 7)]
    rows = minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in rows} == {**dict.fromkeys(range(1, 8), 1), 8: 8, 9: 8, 10: 8, 20: 20, 21: 20}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 3)
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "label": F.lit("x"), "band": F.lit(2)}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in minhash.near_classes(docs).collect()}
    want = brute(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) and got[i]["kept"] == (i == want[i]) for i in got)
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "A b c d e f"), (4, None), (5, "!"), (None, "alone in null here")]
    got = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["class_size"]) for r in got], key=str) == sorted(
        [(None, 3, 3), (3, 3, 3), (3, 3, 3), (4, 4, 2), (5, 4, 2), (None, None, 1)], key=str
    )
    assert sum(r["kept"] for r in got) == 3
    assert minhash.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_leave_out_no_pair_between_classes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60_000, 128).astype("<u2")
    rows = []
    for i in range(12):
        s = base.copy()
        s[: i * 4] = rng.integers(0, 60_000, i * 4)
        rows.append((i, i % 3, 2, s.tobytes()))
    table = pa.table({"id": [r[0] for r in rows], "label": [r[1] for r in rows], "side": [r[2] for r in rows], "signature": [r[3] for r in rows]})
    values = [np.frombuffer(r[3], "<u2") for r in rows]
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if i % 3 != j % 3 and (values[i] == values[j]).mean() >= 0.64}
    found = minhash._tiles(1000, 0.64)((), table).to_pylist()
    assert {(r["a"], r["b"]) for r in found} == want and not any(r["more"] for r in found)
    some = minhash._tiles(1, 0.64)((), table).to_pylist()
    assert len(some) == 3 and all(r["more"] for r in some)


def test_any_internal_name_may_be_a_column_and_rows_may_come_in_any_order(spark):
    from pyspark.sql import functions as F

    docs = spark.range(60).selectExpr("id as doc_id", "concat('one text of several words number ', id % 20) as text", "7 as __row", "8 as row", "9 as `_row`").repartition(5, F.rand())
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(20)) and {(r["__row"], r["row"], r["_row"]) for r in rows} == {(7, 8, 9)}


def test_very_long_texts(spark):
    one = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    docs = spark.createDataFrame([(1, one), (2, one + " tail"), (3, one.replace("w", "v"))], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in minhash.near_classes(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_hot_buckets_are_split_without_a_loss(spark, monkeypatch):
    """Texts about as near as the threshold, in chains and beside others that share most bands with none of them linked."""
    r = random.Random(7)
    base = words(r, 150)
    texts = []
    for share in (1, 2, 2, 3, 4, 6):
        for _ in range(12):
            copy = list(base)
            for at in r.sample(range(len(copy)), share):
                copy[at] = f"x{r.random()}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    for hot, tile in ((3, 2), (10, 256)):
        monkeypatch.setattr(minhash, "HOT", hot)
        monkeypatch.setattr(minhash, "TILE", tile)
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)


def test_overlaps_of_many_pairs_are_exact(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    bags = [minhash.multiset(t) for t in corpus()]
    a, b = map(np.array, zip(*[(i, j) for i in range(len(bags)) for j in range(i)], strict=True))
    assert len(a) >= 4 * len(bags)
    want = [minhash.overlap(bags[i], bags[j]) for i, j in zip(a, b, strict=True)]
    assert np.abs(minhash.overlaps(bags, a, b) - want).max() < 1e-12


def test_a_family_just_below_the_threshold_is_not_written_pair_by_pair(spark, monkeypatch):
    r = random.Random(5)
    base = words(r, 300, 4000)
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in r.sample(range(len(copy)), 6):
            copy[at] = f"x{r.random()}"
        texts.append(" ".join(copy))
    texts[70] = texts[110] + " end"
    written, durable = [], minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: written.append(durable(df)) or written[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    for hot in (minhash.HOT, 50):
        monkeypatch.setattr(minhash, "HOT", hot)
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want and want[110] == 70 and len(set(want)) > 100
    # 7,140 pairs share a band and have signatures near the threshold.
    assert max(df.count() for df in written) < 20 * len(texts)


def test_the_pipelines_stage_grows_with_a_family_and_not_with_its_pairs(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(6)
    base = words(r, 300, 4000)
    texts = []
    for _ in range(96):
        copy = list(base)
        for at in r.sample(range(len(copy)), 6):
            copy[at] = f"x{r.random()}"
        texts.append(" ".join(copy))
    written, durable = [], minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: written.append(durable(df)) or written[-1])
    most = []
    for n in (24, 96):
        written.clear()
        docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts[:n], texts[0] + " end"])], "doc_id long, text string, lang string")
        assert sorted(tuple(row) for row in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [(i, t, "en") for i, t in enumerate(texts[:n])]
        most.append(max(df.count() for df in written))
    assert most[1] < 8 * most[0]


def test_counts_of_shared_elements_are_exact():
    texts = corpus()
    full = [[(t, n) for t, c in bag(x).items() for n in range(c)] for x in texts]
    has = Counter(e for x in full for e in x)
    groups = [[{"pivot": 7, "parts": 3}]] * len(texts)
    dealt = pa.Table.from_batches(list(minhash._parts([pa.record_batch({"id": range(len(texts)), "text": texts, "groups": groups})])))
    size, shared = Counter(), Counter()
    for part in range(3):
        for r in minhash._count((), dealt.filter(pa.compute.equal(dealt["part"], part))).to_pylist():
            size[r["id"]] += r["size"]
            shared[r["id"]] += r["shared"]
    assert [size[i] for i in range(len(texts))] == [len(x) for x in full]
    assert [shared[i] for i in range(len(texts))] == [sum(has[e] > 1 for e in x) for x in full]


def test_the_pipelines_stage_compares_no_text_that_has_too_much_of_its_own(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(8)
    base = words(r, 300, 4000)
    texts = []
    for _ in range(96):
        copy = list(base)
        for at in r.sample(range(len(copy)), 16):
            copy[at] = f"x{r.random()}"
        texts.append(" ".join(copy))
    texts[70] = texts[50] + " end"
    written, durable = [], minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: written.append(durable(df)) or written[-1])
    monkeypatch.setattr(minhash, "HOT", 3)
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(row["doc_id"] for row in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want)) and want[70] == 50
    met = next(df for df in written if "apart" in df.columns)
    large = next(df for df in written if "shared" in df.columns and "apart" not in df.columns) if any("shared" in df.columns for df in written) else met
    assert large.count() > 100 and met.join(large.select("pivot").distinct(), "pivot", "left_semi").count() < 0.1 * large.count()
