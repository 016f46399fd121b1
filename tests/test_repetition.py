"""The detector against the backtracking regex it stands for."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirworks.functions.repetition import has_triple, repetition_loop, text_has_triple


@pytest.mark.parametrize("unit", [1, 2, 3, 5])
def test_matches_the_regex_on_random_lines(unit):
    rx = re.compile(r"(.{%d,})\1{2,}" % unit, re.S)
    rng = random.Random(unit)
    hits = 0
    for _ in range(3000):
        line = "".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.4:
            piece = line[:rng.randint(unit, unit + 6)]
            line = line[:rng.randint(0, 20)] + piece * rng.choice([2, 3]) + line[:rng.randint(0, 5)]
        want = rx.search(line) is not None
        hits += want
        assert has_triple(np.array([ord(c) for c in line], dtype=np.uint16), unit) == want, line
    assert 100 < hits < 3000


def test_a_period_may_start_anywhere():
    unit = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    for lead in range(0, 60, 7):
        assert text_has_triple("x" * lead + "!" + unit * 3 + "?")
        assert not text_has_triple("!" * (lead % 40) + unit * 2 + unit[:-1] + "?")


def test_line_ends_break_a_run():
    unit = "0123456789" * 4 + "abcdefghij"
    assert text_has_triple(unit * 3)
    for end in "\n\r  ":
        assert not text_has_triple(unit + end + unit + end + unit)
    assert text_has_triple("short\n" + unit * 3 + "\nshort")


def test_long_line_without_cube_is_quick_and_clean():
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    assert not text_has_triple(line)
    assert text_has_triple(line + line[:5000] * 3)


def test_column(spark):
    unit = "one sentence that is exactly long enough to be seen. "
    rows = [(0, unit * 3), (1, unit * 2), (2, None), (3, "")]
    got = spark.createDataFrame(rows, "id int, t string").select("id", repetition_loop(F.col("t")).alias("r"))
    assert {r.id: r.r for r in got.collect()} == {0: True, 1: False, 2: False, 3: False}


def test_only_texts_with_a_window_that_stands_again_are_searched(monkeypatch):
    from weirworks.functions import repetition as R
    searched = []
    monkeypatch.setattr(R, "has_triple", lambda line, unit: searched.append(len(line)) or True)
    plain = "".join(chr(0x4E00 + i) for i in range(4000))
    assert not R.text_has_triple(plain) and searched == []
    for unit in (50, 51, 63, 64, 97):
        for lead in range(0, 40, 3):
            assert R.text_has_triple(plain[:lead] + plain[1000:1000 + unit] * 3 + plain[100:100 + lead])


def test_texts_of_short_lines_are_not_hashed(monkeypatch):
    from weirworks.functions import repetition as R
    hashed, again = [], R._stands_again
    monkeypatch.setattr(R, "_stands_again", lambda line: hashed.append(len(line)) or again(line))
    assert not R.text_has_triple("def run(a):\n    return a\n" * 60) and hashed == []
    for end, n in (("\n", 149), ("\r", 149), ("\u2028", 74), ("\u2029", 74), ("\u00e9\n", 73)):
        assert not R.text_has_triple(("x" * n + end) * 40) and hashed == []
        assert R.text_has_triple(("x" * n + end) * 40 + "0123456789" * 15 + end)
        hashed.clear()
    # characters that take two units: 75 of them fill a line of 150
    assert R.text_has_triple("short\n" * 30 + "".join(map(chr, range(0x1F600, 0x1F619))) * 3)
