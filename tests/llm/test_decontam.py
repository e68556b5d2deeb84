import random

import pytest
from pyspark.sql import functions as F

from oscilla.llm import decontam

ITEM = "Tom Baker buys 12 apples for 30 cents and gives Tom Baker 5 km of rope before the train from Paris leaves at 9 hours."
OTHER = "Why do rivers bend more in flat land than in the hills above them?"


def found(text, items=((7, ITEM), (8, OTHER))):
    return {i: c for i, c, _ in decontam.Block(list(items)).leaks(text)}


def test_copies_in_any_case_and_place():
    for text in (ITEM, f"So they say: {ITEM} And so on.", ITEM.replace(" ", "\n", 3), f"xx yy. {OTHER.upper()}", OTHER.lower()):
        assert found(text)


def test_other_figures_names_and_units_are_the_same_question():
    again = ITEM.replace("Tom Baker", "Ann Miller").replace("12", "48").replace("30", "75").replace("cents", "euros").replace("Paris", "Rome").replace("km", "miles")
    assert 7 in found(again)


def test_slots_must_stand_for_one_value():
    again = ITEM.replace("Tom Baker buys", "Ann Miller buys")  # the second Tom Baker stays
    assert found(again).get(7, 0) < found(ITEM)[7]


def test_other_questions_are_left_alone():
    assert not found("Tom Baker buys 12 apples and nothing else, whereas the train from Lyon is late again today.")
    assert not found("") and not found("12 13 14 15 16 17 18")


def brute(docs, items):
    """Five-word windows compared as tuples, for texts without slots."""
    out = set()
    grams = lambda t: {tuple(w[i : i + 5]) for w in [decontam._TOKEN.findall(t.lower())] for w in [[x for x in w if x not in ".!?\n"]] for i in range(len(w) - 4)}
    for d, t in docs:
        own = grams(t or "")
        for i, q in items:
            want = grams(q)
            if want and len(want & own) >= 0.8 * len(want):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [10**9, 50])
def test_against_brute_force_in_one_block_or_many(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            q = items[r.randrange(12)][1].split()
            q = q[: max(5, int(len(q) * r.choice((0.5, 0.8, 0.9, 1.0))))]
            at = r.randrange(len(w) + 1)
            w[at:at] = q
        docs.append((d, " ".join(w)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(a, b).collect()}
    assert got == brute(docs, items)
    kept = decontam.drop_leaks(a.withColumn("item_id", F.lit("x")), b)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_short_items_nulls_and_repeats(spark):
    items = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (None, OTHER)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are two words again"), (1, "here are two words again"), (2, None), (3, ""), (None, OTHER)], "doc_id long, text string")
    got = sorted([(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()], key=str)
    assert got == [(1, 1), (1, 1), (None, None)]
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), items).count() == 0


def test_names_at_the_start_of_a_sentence_and_capitals_after_anything():
    item = "Tom has 12 apples. Ann has 5 pears. How many apples do Tom and Ann have"
    assert found(item.replace("Tom", "Bob").replace("12", "48").replace("Ann", "Eve").replace("5", "7"), [(1, item)])
    short = "What is the tallest mountain on Earth"
    named = "Berlin lies on which river"
    for before in ("", "Q: ", "Question: ", "so, ", "(", "x. "):
        assert found(before + short, [(1, short)]) == {1: 1.0}
        assert found(before + named, [(1, named)]) == {1: 1.0}
    assert not found("Anna Berta Carla Dora Emma Frida", [(1, "Great Gatsby Summary Analysis Notes")])


def test_an_item_and_variants_of_it_in_one_document():
    item = "A farmer sells 12 eggs for 30 cents and then buys 5 hens for 80 cents from his old friend"
    variants = [item.replace("12", str(n)).replace("30", str(n + 1)).replace(" 5 ", f" {n + 2} ").replace("80", str(n + 3)) for n in (48, 15, 7, 20)]
    for text in (item + " " + variants[0], ". ".join([*variants, item]), ". ".join([variants[0], item, *variants[1:]])):
        assert found(text, [(1, item)]) == {1: 1.0}
    longer = item.replace("and then", "and shortly then")
    assert found(". ".join([variants[1], longer]), [(1, item)])
    mixed = item.replace("for 80 cents from his old friend", "for 80 cents from his old friend, 12 and 12 again")
    assert not found(item[:30] + " and so on", [(1, mixed)])


def test_every_item_of_the_table_in_any_case():
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    block = decontam.Block(items)
    for i, text in items:
        for copy in (text, text.lower(), text.upper(), f"Intro words here. {text.upper()} And an end."):
            assert i in {x for x, _, _ in block.leaks(copy)}, (i, copy)
    lowered = ITEM.lower(), ITEM.upper()
    assert all(found(x) for x in lowered)


def slow_leaks(text, item):
    """Coverage by the definition: all pairs of windows, slots compared by hand, in texts that hold one occurrence."""
    (_, tk, tt), (_, ok, ot) = decontam.template(item), decontam.template(text)
    size = min(5, len(tt))
    usable = [q for q in range(len(tt) - size + 1) if sum(tk[q : q + size] == decontam._WORD) >= min(2, max(sum(tk[j : j + size] == decontam._WORD) for j in range(len(tt) - size + 1)))]
    pairs = []
    for q in usable:
        for p in range(len(ot) - size + 1):
            slots, words, same = [], 0, True
            for a, b, ka, kb in zip(tt[q : q + size], ot[p : p + size], tk[q : q + size], ok[p : p + size], strict=True):
                a, b = a.casefold(), b.casefold()
                if ka == kb and ka != decontam._WORD:
                    slots.append((a, b))
                elif {ka, kb} <= {decontam._WORD, decontam._NAME} and a == b:
                    slots += [(a, b)] if ka == decontam._NAME else []
                else:
                    same = False
                words += a == b and ka in (decontam._WORD, decontam._NAME)
            literals = sum(k in (decontam._WORD, decontam._NAME) for k in tk[q : q + size])
            if same and words >= min(2, literals):
                pairs.append((q, slots))
    binding = {}
    for _, slots in pairs:
        for a, b in slots:
            binding.setdefault(a, []).append(b)
    chosen = {a: max(sorted(set(b), reverse=True), key=lambda x: (b.count(x), x)) for a, b in binding.items()}
    return len({q for q, slots in pairs if all(chosen[a] == b for a, b in slots)}) / len(usable) if usable else 0.0


def test_slot_consistency_against_brute_force():
    r = random.Random(12)
    names, caught = ["Ann", "Bob", "Eve", "Tom"], [0, 0]
    for _ in range(300):
        item = f"{r.choice(names)} sells {r.randint(2, 9)} old red pots to {r.choice(names)} and later buys {r.randint(2, 9)} new blue pots from {r.choice(names)} for {r.randint(2, 9)} euros in town"
        words = item.split()
        for k, w in enumerate(words):
            if w in names and r.random() < 0.5:
                words[k] = r.choice(names)
            elif w.isdigit() and r.random() < 0.5:
                words[k] = str(r.randint(2, 9))
            elif r.random() < 0.03:
                words[k] = "other"
        text = " ".join(words)
        want = slow_leaks(text, item)
        got = found(text, [(1, item)]).get(1, 0.0)
        assert got == (pytest.approx(want) if want >= 0.8 else 0.0)
        caught[got > 0] += 1
    assert min(caught) > 30


def test_many_texts_at_once_and_very_long_ones():
    r = random.Random(13)
    fill = lambda n: " ".join("".join(r.choices("abcdef", k=r.randint(1, 6))) for _ in range(n))
    texts = ["", ITEM, fill(50), f"{fill(40_000)} {OTHER} {fill(150_000)} {ITEM}", OTHER[:30], OTHER[30:], fill(3)]
    block = decontam.Block([(7, ITEM), (8, OTHER)])
    together = block.leaks_of(texts)
    assert together == [block.leaks(t) for t in texts]
    assert [{i for i, _, _ in x} for x in together] == [set(), {7}, set(), {7, 8}, set(), set(), set()]


@pytest.mark.parametrize("block", [10**9, 50])
def test_clashing_columns_and_slots_in_either_join(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    b = spark.createDataFrame([(7, ITEM), (8, OTHER), (8, OTHER), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, ITEM.replace("12", "17"), 5, "a"), (1, ITEM.replace("12", "17"), 5, "a"), (2, None, 6, "b"), (3, OTHER.upper(), 7, "c"), (None, "", 8, "d")],
        "doc_id long, text string, row long, item_id string",
    )
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, b).collect())
    assert got == [(1, 7), (1, 7), (3, 8), (3, 8)]
    kept = decontam.drop_leaks(docs, b)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [6, 8]
    assert decontam.drop_leaks(docs.limit(0), b).count() == 0
