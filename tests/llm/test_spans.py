import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import spans
from corvine.llm.recompress import parse


def brute(rows, least):
    """Characters of each id that lie in a span of ``least`` characters which another id holds."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    holders = {}
    for i, t in rows:
        for p in range(len(t) - least + 1):
            holders.setdefault(t[p : p + least], set()).add(i)
    out = {}
    for i, t in rows:
        covered = [False] * len(t)
        for p in range(len(t) - least + 1):
            if holders[t[p : p + least]] - {i}:
                covered[p : p + least] = [True] * least
        if any(covered):
            out[i] = max(out.get(i, 0), sum(covered))
    return out


def text(r, n, alphabet="abcdefgh ij\n"):
    return "".join(r.choice(alphabet) for _ in range(n))


def check(spark, rows, least=spans.LEAST):
    df = spark.createDataFrame(rows, "id long, text string, key string")
    got = {r.id: r.shared_chars for r in spans.shared_spans(df.repartition(3), "text", "id", least).collect()}
    assert got == brute([(i, t) for i, t, _ in rows], least)
    return got


def test_against_brute_force(spark):
    r = random.Random(1)
    passages = [text(r, n) for n in (199, 200, 201, 260, 420)]
    rows = [(i, text(r, r.randrange(0, 400)), "x") for i in range(40)]
    for i, p in enumerate(passages * 3):
        rows.append((100 + i, text(r, r.randrange(0, 90)) + p + text(r, r.randrange(0, 90)), "x"))
    copy = text(r, 300)
    rows += [(200, copy, "x"), (201, copy, "x"), (202, copy[:199], "x"), (203, text(r, 250), "x"), (203, None, "x"), (None, copy, "x"), (204, "", "x")]
    rows += [(205, "same row " * 40, "x"), (205, "same row " * 40, "x")]  # a repeated row is the same record
    got = check(spark, rows)
    assert len(got) > 12 and 202 not in got


@pytest.mark.parametrize("unit", ["a", "ab", "-", "abc def ", "\n", "é中"])
def test_periodic_texts(spark, unit):
    r = random.Random(2)
    long = unit * 600
    rows = [(1, long[:250], "x"), (2, text(r, 50) + long[:230] + text(r, 30), "x"), (3, long[:205] + text(r, 99), "x"), (4, long[:199], "x"), (5, text(r, 10) + long[:201], "x")]
    check(spark, rows)


def test_a_hot_header_and_hot_copies(spark):
    r = random.Random(3)
    header = text(r, 240)
    rows = [(i, header + text(r, 200), "x") for i in range(60)] + [(100 + i, header * 2, "x") for i in range(40)] + [(300 + i, text(r, 300), "x") for i in range(30)]
    assert len(check(spark, rows)) == 100


def test_empty_tables_and_short_texts(spark):
    df = spark.createDataFrame([(1, "a" * 150, "x"), (2, "a" * 150, "x")], "id long, text string, key string")
    assert spans.shared_spans(df, "text", "id").count() == 0
    assert spans.shared_spans(df.limit(0), "text", "id").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab c", min_size=40, max_size=300), st.text(alphabet="ab c", max_size=60), st.text(alphabet="ab c", max_size=60))
def test_a_symbol_stands_wherever_its_context_does(inner, before, after):
    """The stretch a symbol depends on yields that symbol, whatever stands around it."""
    one, two = parse([inner]), parse([before + inner + after])
    other = set(zip(two.name.tolist(), (two.low - len(before)).tolist(), (two.high - len(before)).tolist()))
    for name, low, high in zip(one.name.tolist(), one.low.tolist(), one.high.tolist()):
        if low >= 0 and high <= len(inner):
            assert (name, low, high) in other


def test_symbols_cover_the_texts():
    r = random.Random(4)
    texts = ["", text(r, 500), "a" * 90, "x", text(r, 77)]
    s = parse(texts)
    assert np.bincount(s.text, weights=s.size, minlength=5).tolist() == [len(t) for t in texts]
    assert (s.low <= s.start).all() and (s.high >= s.start + s.size).all()


def test_texts_of_one_id_are_no_other_record(spark):
    r = random.Random(8)
    own, both = text(r, 260), text(r, 240)
    rows = [(1, "a" + own + "b", "x"), (1, "c" + own + "d", "x"), (2, "e" + both, "x"), (2, "f" + both, "x"), (3, both + "g", "x"), (4, own[:199], "x")]
    assert set(check(spark, rows)) == {2, 3}
    assert set(check(spark, [*rows, (5, "h" + own, "x")])) == {1, 2, 3, 5}
