"""Spans of very long runs, in time that grows with the text, and equal to those of the plain patterns."""

import random
import re
import time

import pytest

from framegrid.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_the_plain_patterns():
    r = random.Random(1)
    for _ in range(30_000):
        text = "".join(r.choice(r.choice(("0123456789", "ab@.-", "1.2@ +()-", "0 -"))) for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("unit", ["a", "1", "-", "(", "1.", "a@", "a@b.cd,", "u12345 ", "-1", "1 ", "a1b2c3@x ", "+1 ", "+1-", "%", " "])
def test_a_megabyte_of_one_run(unit):
    text = "write to +1" + unit * (1_000_000 // len(unit)) + " or to number x@y.zz today"
    start = time.process_time()
    spans = pii.base_spans(text)
    rows = pii.occurrences(text, spans)
    assert time.process_time() - start < 6
    assert (text.index("x@y.zz"), 0, text.index("x@y.zz") + 6) in spans
    assert any(r["instance"] == "x@y.zz" for r in rows)
    short = "write to +1" + unit * 40 + " or to number x@y.zz today"
    assert pii.base_spans(short) == plain_spans(short)


def test_words_that_spans_overlap_are_no_occurrences():
    text = "to member a1b2c3@ex.org, to member 1.2.3.4x5y6 and to member AB-12345-X now"
    rows = pii.occurrences(text, pii.base_spans(text))
    assert [r["instance"] for r in rows if not r["seed"]] == ["ab-12345-x"]
