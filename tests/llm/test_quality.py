import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from oscilla.llm import quality


def test_grades_of_invented_text_are_recovered():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    def text(g):
        p = np.ones(60)
        p[:20] += 6 * (g == 0)
        p[20:40] += 6 * (g == 1)
        p[40:] += 6 * (g == 2)
        return " ".join(rng.choice(words, 80, p=p / p.sum()))
    grades = list(rng.integers(0, 3, 400))
    model = quality.train([text(g) for g in grades], grades)
    assert (np.diff(model.thresholds) > 0).all()
    new = list(rng.integers(0, 3, 150))
    tails = np.array([model.tails(text(g)) for g in new])
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(axis=1)
    means = [expected[np.array(new) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_held_out_accuracy_on_the_tables(spark):
    base = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{base}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{base}/labels.parquet").to_pylist()}
    train = [i for i in labels if i % 4]
    model = quality.train([docs[i] for i in train], [labels[i] for i in train])
    held = [i for i in labels if i % 4 == 0]
    score = np.array([model.tails(docs[i])[0] for i in held])
    good = np.array([labels[i] for i in held]) == 1
    assert (score[good][:, None] > score[~good][None, :]).mean() > 0.95
    assert (score[good] >= 0.5).mean() > 0.97


def test_scores_of_a_frame(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in quality.grades(labels).collect()} == {1: 2, 2: 0, 3: 1}
    docs = spark.createDataFrame([(1, "good words here"), (2, "%%% %%%"), (3, "good nasty words"), (None, None), (5, ""), (5, "")], "doc_id long, text string")
    model = quality.fit(docs, quality.grades(labels))
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    by = {r["doc_id"]: r["expected_grade"] for r in rows}
    assert by[1] > by[2]
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.fit(docs, quality.grades(labels.limit(0)))
    assert not any(r["kept"] for r in quality.score(docs, nothing).collect())


@pytest.mark.parametrize(("grades", "kept"), [([1, 1], True), ([0, 0], False)])
def test_one_grade_only(grades, kept):
    model = quality.train(["a b", "c d"], grades)
    assert bool(model.tails("a b")[0] >= 0.5) is kept


def slow_tails(model, text):
    """By the definition, feature by feature in a dictionary."""
    import math

    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    tokens = quality._TOKEN.findall(text)
    code = lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
    seen = {}
    for k, t in enumerate(tokens):
        own = [code(t), code("\0upper" if t.isupper() and len(t) > 1 else "\0long" if len(t) > 24 else "\0sign" if not t[0].isalnum() else "\0word")]
        if k:
            own.append(mixed((code(tokens[k - 1]) * 0x9E3779B97F4A7C15 + code(t)) & mask))
            own += [7] if tokens[k - 1] == t else []
        for f in own:
            slot = f % (quality.SLOTS - 1) + 1
            seen[slot] = seen.get(slot, 0) + 1
    values = {s: math.log1p(n) for s, n in seen.items()}
    norm = max(1e-9, math.sqrt(sum(v * v for v in values.values())))
    z = 0.2 * model.weights[0] + sum(model.weights[s] * v / norm for s, v in values.items())
    return [1 / (1 + math.exp(-(z - t))) for t in model.thresholds]


def test_tails_and_likelihood_against_brute_force():
    texts = ["good words, good people", "BAD bad!! bad\n\nbad", "x" * 40 + " fine", "", "plain words about people", "good and plain", "!!! ??? $$$", "words words words"]
    grades = [2, 0, 1, 0, 2, 2, 0, 1]
    model = quality.train(texts, grades)
    for t in [*texts, "unseen words here", "good " * 5000]:
        assert model.tails(t) == pytest.approx(slow_tails(model, t), abs=1e-9)

    def likelihood(m):
        edges = [[1.0, *slow_tails(m, t), 0.0] for t in texts]
        return sum(np.log(e[g] - e[g + 1]) for e, g in zip(edges, grades, strict=True))

    # Any step away from what was learned, in the thresholds or along a text's features, is less likely or nearly as likely.
    blank = quality.OrdinalModel(np.zeros_like(model.weights), model.thresholds)
    assert likelihood(model) > likelihood(blank)
    rng = np.random.default_rng(3)
    for _ in range(10):
        moved = quality.OrdinalModel(model.weights + rng.normal(size=len(model.weights)) * (model.weights != 0), model.thresholds)
        assert likelihood(moved) < likelihood(model) + 0.5


def test_very_long_texts_ties_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good words here", 1, 2), (2, "%%% %%%", 1, 2), (3, "good words here", 1, 2), (4, "good words " * 200_000, 1, 2)], "doc_id long, text string, grade int, kept int")
    model = quality.fit(docs, quality.grades(labels))
    by = {r["doc_id"]: r["expected_grade"] for r in quality.score(docs, model).collect()}
    assert by[1] == by[3] > by[2] and by[4] > by[2]
    tail = [float(model.tails("good words here")[0])]
    rows = quality.score(docs, model, probability=tail[0]).collect()
    assert [r["kept"] for r in rows if r["doc_id"] in (1, 3)] == [True, True]
