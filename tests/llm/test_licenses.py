"""License rules on texts that hold nothing else."""

import random
import time
from re import _parser

import pytest

from hemtally.llm import license_scan

#: Of all rules this one alone needs a word outside its match.
BESIDES = {"you may not use this file": "apache. "}


def written(pattern, r):
    """A random text of the pattern's form; what it must not be followed by is not looked at."""

    def of(items):
        out = ""
        for op, arg in items:
            match str(op):
                case "LITERAL":
                    out += chr(arg)
                case "ANY":
                    out += "x"
                case "IN":
                    out += of([r.choice(arg)])
                case "CATEGORY":
                    out += " " if str(arg) == "CATEGORY_SPACE" else "x"
                case "RANGE":
                    out += chr(arg[0])
                case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT":
                    out += "".join(of(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 1))))
                case "SUBPATTERN":
                    out += of(arg[3])
                case "BRANCH":
                    out += of(r.choice(arg[1]))
                case "AT" | "ASSERT_NOT":
                    pass
                case _:
                    raise NotImplementedError(op)
        return out

    return of(_parser.parse(pattern.pattern, pattern.flags))


def test_every_rule_is_heard_in_a_text_of_its_own():
    r = random.Random(0)
    missed, tried = [], 0
    for _, label, _, pattern, _ in license_scan.rules():
        for _ in range(12):
            text = written(pattern, r)
            assert pattern.search(text), (pattern.pattern, text)
            text = next((v for k, v in BESIDES.items() if text.startswith(k)), "") + text
            tried += 1
            if not license_scan.detections(text):
                missed.append((label, text))
    assert tried > 3000 and not missed


@pytest.mark.parametrize(
    "text, label",
    [
        ("Apache-2.0", "apache-2.0"), ("Apache 2.0", "apache-2.0"), ("MPL-2.0", "mpl-2.0"), ("EPL 2.0", "epl-2.0"), ("EUPL-1.2", "eupl-1.2"), ("CDDL 1.0", "cddl-1.0"),
        ("Artistic-2.0", "artistic-2.0"), ("OFL 1.1", "ofl-1.1"), ("BSL-1.0", "bsl-1.0"), ("eupl.eu", "eupl"), ("sun.com/cddl", "cddl"), ("the unlicence", "unlicense"),
        ("released under the Foo licence", "unknown-license"),
    ],
)
def test_a_mention_counts_without_the_word_license(text, label):
    assert [x[2] for x in license_scan.detections(text.lower())] == [label]


def test_a_sentence_of_several_licenses_needs_the_name():
    sentence = "you may not use this file except in compliance with the license"
    assert license_scan.detections(sentence) == []
    assert [x[2] for x in license_scan.detections(f"apache: {sentence}")] == ["apache"]


WRAPPED = [
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", ["bsd"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", ["isc"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event", ["zlib"]),
    ("Neither the name of the copyright holder nor the names of its\n   contributors may be used", ["bsd-3-clause"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"]),
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy", ["mit"]),
    ("                                 Apache License\n                           Version 2.0, January 2004", ["apache-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", ["gpl-3.0"]),
    ("Mozilla\tPublic  License,\r\nversion\xa02.0", ["mpl-2.0"]),
    ("the GNU General Public License as published, version\n2. It", ["gpl"]),
    ("GNU General Public License version\n2. It", ["gpl-2.0"]),
    ("Creative Commons Attribution-\nShareAlike 4.0", ["cc-by-sa-4.0"]),
]


def commented(text, mark):
    return "".join(mark + line for line in text.splitlines(keepends=True))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl ", "> > ", "#"])
@pytest.mark.parametrize("text, labels", WRAPPED)
def test_wrapped_texts_have_their_labels_and_places(text, labels, mark):
    text = "\U0001f600\n\n\tx  y\n" + commented(text, mark) + "\n\nend"
    got = license_scan.detections(text.lower())
    assert [x[2] for x in got] == labels
    for start, end, _, _ in got:
        alone = license_scan.detections(text[start:end].lower())
        assert alone and (alone[0][0], alone[-1][1]) == (0, end - start)


def test_a_list_after_a_name_gives_no_version():
    for text in ("Apache License\n\n   1. Definitions.\n2. Grant", "under the GPL\n 3) more", "# EPL\n# 2. more"):
        assert all("-" not in x[2] for x in license_scan.detections(text.lower()))


def plain_standing(found):
    """Every detection against all that stand, by priority, then longer first, then earlier, then the rules' order."""
    stands = []
    for p, start, end, order, *rest in sorted(found, key=lambda x: (x[0], x[1] + x[2], x[1], x[3])):
        end = -end
        if not any((s <= start and end <= e) or (start < e and s < end and q < p) for s, e, q, *_ in stands):
            stands.append((start, end, p, *rest))
    return stands


@pytest.mark.parametrize("seed", range(30))
def test_suppression_is_that_of_a_plain_version(seed):
    r = random.Random(seed)
    found = []
    for order in range(r.randint(0, 60)):
        start = r.randrange(80)
        found.append((r.randrange(4), start, -(start + r.randint(1, 25)), order, f"l{order}", 0.5))
    assert sorted(license_scan.standing(found)) == sorted(plain_standing(found))


def test_a_hundred_thousand_mentions_take_seconds():
    begin = time.monotonic()
    found = license_scan.detections("mit license and " * 100_000)
    assert len(found) == 100_000 and time.monotonic() - begin < 20


def test_signatures_are_hundreds():
    assert len(license_scan.TEXTS) > 100 and len(license_scan.rules()) > 500
