import random
import re

from lamella.llm import license_scan
from lamella.llm.license_rules import Rule, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_base_phrases_as_by_hand():
    chance, one = random.Random(3), license_scan.Scanner(rules(), license_scan.PHRASES)
    bits = ["MIT", "License", "apache", "general", "public", "license", "é", "x", "licensed", "mit", "ß9", "0"]
    for _ in range(500):
        text = "".join(chance.choice(bits) + chance.choice([" ", "-", "\n", ".", "", "\x7f", "_", " "]) for _ in range(chance.randint(0, 25)))
        found = one.scan(text)
        assert found[:5] == base_by_hand(text), text
        assert set(filter(None, found[4].split(","))) <= set(filter(None, found[5].split(",")))


def test_there_are_hundreds_of_rules_and_each_name_is_found():
    assert len(rules()) > 300 and len({r.pattern for r in rules()}) > 300
    one = license_scan.Scanner(rules(), license_scan.PHRASES)
    for text, label in {
        "Licensed under the Apache License,\n Version 2.0": "apache-2.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0", "released under the MIT licence": "mit",
        "the GNU Lesser General Public License v2.1": "lgpl-2.1", "under CC BY-SA 4.0": "cc-by-sa-4.0", "the zlib license": "zlib",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit", "spdx-license-identifier: (MIT OR Apache-2.0)": "apache-2.0",
        "Copyright (c) 2001 X. All rights reserved": "proprietary", "GNU Affero General Public License version 3": "agpl-3.0", "the 3-clause BSD license": "bsd-3-clause",
    }.items():
        assert label in one.scan(text)[5].split(","), text
    assert one.scan("we had a general election and a public holiday; no license")[5] == ""


def test_prefilter_loses_nothing():
    chance, chosen = random.Random(5), rules()
    one = license_scan.Scanner(chosen, {})
    pieces = ["mit", "apache", "license", "licensed under the", "gnu", "gpl", "general", "public", "version", "2.0", "3", "bsd", "3-clause", "creative commons", "attribution", "cc-by", "4.0", "under", "spdx-license-identifier:", "\n", "eclipse"]
    for _ in range(300):
        text = " ".join(chance.choice(pieces) for _ in range(20))
        assert sorted((a, b, r.order) for a, b, r in one.matches(text)) == sorted((m.start(), m.end(), r.order) for r in chosen for m in re.finditer(r.pattern, text))


def test_suppression_as_by_hand():
    chance = random.Random(9)
    for _ in range(400):
        matches = []
        for k in range(chance.randint(0, 12)):
            a = chance.randint(0, 20)
            matches.append((a, a + chance.randint(1, 10), Rule(k, f"l{k}", chance.choice(["signature", "tag", "grant", "mention"]), (), "")))

        def beats(x, m):
            if x is m or not (x[0] <= m[0] and m[1] <= x[1]):
                return False
            p, q, longer = x[2].priority, m[2].priority, (x[1] - x[0]) - (m[1] - m[0])
            return p > q or p == q and (longer > 0 or longer == 0 and x[2].order < m[2].order)

        assert sorted(license_scan.unsuppressed(matches), key=lambda m: m[2].order) == [m for m in matches if not any(beats(x, m) for x in matches)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "The MIT License. " * 3000, "c"), (3, "x", "d"), (None, "mit license", "e")], "doc_id long, text string, labels string")
    out = {(r.doc_id, r.n_words): r for r in license_scan.scan(docs).collect()}
    assert len(out) == 5 and out[1, 0].labels == "" and out[1, 0].score == 0 and out[2, 0].first_word is None
    long = out[3, 9000]
    assert (long.n_base, long.first_word, long.last_word, long.labels) == (3000, 1, 8998, "mit") and len(long.spans) == 3000
    assert out[None, 2].base_labels == "mit"
    assert license_scan.scan(docs.limit(0)).count() == 0


def one_of(parsed, chance):
    """A text that a parsed pattern matches: of alternatives any, of what may be left out sometimes nothing."""
    out = ""
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kind, x = value[0]
            out += {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "w"}[str(x)] if str(kind) == "CATEGORY" else "(" if str(kind) == "NEGATE" else chr(x)
        elif op in ("ANY", "NOT_LITERAL"):
            out += "x"
        elif op == "MAX_REPEAT":
            low, high, inner = value
            out += "".join(one_of(inner, chance) for _ in range(chance.randint(low, min(high, max(low, 1)))))
        elif op == "SUBPATTERN":
            out += one_of(value[-1], chance)
        elif op == "BRANCH":
            out += one_of(chance.choice(value[1]), chance)
        else:
            assert op in ("AT", "ASSERT_NOT"), op
    return out


def test_every_alternative_of_a_pattern_passes_its_gate():
    chance, lost = random.Random(11), set()
    for r in rules():
        pattern, parsed = re.compile(r.pattern), re._parser.parse(r.pattern)
        for _ in range(100):
            text = one_of(parsed, chance)
            if pattern.search(text) and not all(any(all(w in text for w in words) for words in alternatives) for alternatives in r.keywords):
                lost.add((r.label, r.kind))
    assert not lost
    one = license_scan.Scanner(rules(), {})
    for text, label in {"gnu library general public license 2.0": "lgpl-2.0", "common development and distribution license 1.1": "cddl-1.1", "cc zero": "cc0-1.0", "one-clause bsd": "bsd-1-clause", "the unlicence": "unlicense", "expat license": "mit", "mit-0": "mit-0"}.items():
        assert label in one.scan(text)[5].split(","), text
