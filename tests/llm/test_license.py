import pytest

from oscilla.llm import license


@pytest.fixture(scope="module")
def scanner():
    return license.Scanner()


@pytest.mark.parametrize("k", range(len(license.TEMPLATES)))
def test_every_template_is_found_where_it_stands(scanner, k):
    name, kind, wording = license.TEMPLATES[k]
    wording = wording.replace("<holder>", "2024 Some People, Inc")
    text = f"Some prose before it.\n{wording}\nAnd prose after."
    found = scanner.scan(text)
    assert [(f.license, f.kind) for f in found] == [(name, kind)]
    assert not found[0].missing and not found[0].added
    assert text[found[0].start : found[0].end].startswith(wording.split()[0])


def test_wording_decides_between_like_licenses(scanner):
    assert [f.license for f in scanner.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [f.license for f in scanner.scan("licensed under the GNU General Public License, version 2. This work is")] != ["GPL-3.0"]


def test_small_differences_are_told(scanner):
    text = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following terms are met"
    (found,) = scanner.scan(text)
    assert found.license == "BSD" and found.added == ("any", "terms") and found.missing == ("conditions",)


def test_prose_about_licenses_is_none(scanner):
    for text in ("", "She has a driving license and a copyright question.", "Permission was given. The license came later, they said.", "x" * 50_000):
        assert scanner.scan(text) == []


def test_a_notice_inside_a_very_long_line(scanner):
    text = "word " * 4000 + "Released under the MIT License. " + "word " * 4000 + "Licensed under the Apache License, Version 2.0. end"
    assert [(f.license, text[f.start : f.end]) for f in scanner.scan(text)] == [("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]


def test_alignment_is_edit_distance():
    assert license.align(["a", "b", "c"], ["x", "a", "b", "c", "y"])[:3] == (0, 1, 4)
    assert license.align(["a", "b", "c"], ["a", "c"])[:3] == (1, 0, 2)
    assert license.align(["a", "<s>", "c"], ["a", "q", "r", "c"])[0] == 0
    assert license.align(["a", "<s>", "c"], ["a", "c"])[0] == 0
    assert license.align(["a"], [])[0] == 1


def test_frame_against_a_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = sorted((r["doc_id"], name) for r in docs.collect() for name, n in notices.items() for _ in range((r["text"] or "").count(n)))
    got = sorted((r["doc_id"], r["license"]) for r in license.find_licenses(docs).collect() if r["exact"])
    assert got == want


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "Licensed under CC BY 4.0."), (2, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    assert sorted([r["doc_id"] for r in license.find_licenses(docs).collect()], key=str) == [2, 2, None]
    assert license.find_licenses(docs.limit(0)).count() == 0


CANONICAL = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "Apache-2.0": " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0",
    "GPL": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
}


@pytest.mark.parametrize("name", CANONICAL)
def test_wording_wrapped_over_lines(scanner, name):
    (found,) = scanner.scan(f"Some prose.\n\n{CANONICAL[name]}\n\nAnd prose after.")
    assert found.license == name and not found.missing and not found.added


def test_every_notice_of_a_line_is_a_row(scanner):
    text = "Licensed under CC BY 4.0. A word between. Licensed under CC BY 4.0. " * 100
    assert [f.license for f in scanner.scan(text)] == ["CC-BY-4.0"] * 200


def wrapped(text, width):
    import textwrap

    return "\n".join(" * " + line for line in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))


@pytest.mark.parametrize("width", [40, 72, 100])
@pytest.mark.parametrize("k", range(len(license.TEMPLATES)))
def test_every_template_is_found_however_it_is_wrapped(scanner, k, width):
    name, kind, wording = license.TEMPLATES[k]
    text = f"Some code.\n/*\n{wrapped(wording.replace('<holder>', 'Some People'), width)}\n */\nMore code, much more of it."
    found = scanner.scan(text)
    assert [(f.license, f.kind) for f in found] == [(name, kind)] and not found[0].missing


def test_a_full_text_with_other_words_is_one_finding(scanner):
    full = next(t for n, k, t in license.TEMPLATES if (n, k) == ("BSD-3-Clause", "full"))
    text = wrapped(full.replace("the copyright holder nor", "Example Corporation nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS"), 72)
    (found,) = scanner.scan(f"Copyright 2020\n\n{text}\n\n#include")
    assert (found.license, found.kind) == ("BSD-3-Clause", "full") and {"example", "corporation", "regents"} <= set(found.added)


def test_templates_without_a_usual_word_are_found():
    own = license.Scanner((("Own", "notice", "These pages may be copied by anybody who cites them properly"),))
    assert [f.license for f in own.scan("x\nThese pages may be copied\nby anybody who cites them properly. y")] == ["Own"]


def test_against_alignment_of_every_template_with_the_whole_text(scanner):
    import random

    r = random.Random(3)
    for _ in range(40):
        words = ["".join(r.choices("abcdef", k=4)) for _ in range(r.randint(0, 60))]
        want = []
        for name, kind, wording in r.sample(license.TEMPLATES[:20], 2):
            part = wording.replace("<holder>", "Some People").split()
            if r.random() < 0.3 and len(part) > 12:
                part[r.randrange(3, len(part) - 3)] = "changed"
            at = r.choice([0, len(words)])
            words[at:at] = [*part, "zz", "zz"]
        text = " ".join(words)
        plain = [w for w, _, _ in license._words(text)]
        for name, kind, wording in license.TEMPLATES:
            template = [w for w, _, _ in license._words(wording)]
            cost, a, b, *_ = license.align(template, plain)
            if b > a and cost <= 2 * license.DIFFERENT * sum(w[0] != "<" for w in template):
                want.append((2 * cost - sum(w[0] != "<" for w in template), name))
        # Whatever explains most of all is among the findings.
        assert min(want)[1] in {f.license for f in scanner.scan(text)}, text


def test_ties_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY 4.0. Licensed under CC BY 4.0.", 5, "x")], "doc_id long, text string, start int, license string")
    rows = license.find_licenses(docs).collect()
    assert [(r["license"], r["start"]) for r in rows] == [("CC-BY-4.0", 0), ("CC-BY-4.0", 26)]
    assert license.find_licenses(docs.limit(0)).count() == 0
