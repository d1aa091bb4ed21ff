import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.operators import chunking
from corvine.operators.chunking import Section, code_pieces, in_fence, markdown_pieces


def section(lines, fenced=None):
    s = Section(lines)
    s.last = len(lines)
    if fenced:
        s.fenced = fenced
    return s


@pytest.mark.parametrize(
    "lines, fenced",
    [
        (["a", "```", "code", "```", "b"], "FTTTF"),
        (["a", "```", "code"], "FTT"),
        (["```", "```", "```"], "TTT"),
        (["```", "code", "~~~", "more"], "TTTF"),
        (["  ```py", "x", "  ```"], "TTT"),
    ],
)
def test_fences(lines, fenced):
    assert in_fence(lines) == [c == "T" for c in fenced]


@pytest.mark.parametrize(
    "lines, fenced, longest, shortest, cut",
    [
        (["aaa", "", "bbb"], None, 5, 2, (0, 0)),
        (["aaa", "", "bbb", "ccc"], [False, True, True, False], 9, 2, (2, 0)),
        (["a", "b.c", "d"], None, 5, 1, (1, 1)),
        (["a", "b c", "d"], None, 5, 1, (1, 1)),
        (["a", "bc", "d"], None, 5, 1, (1, 0)),
        (["aaa"], None, 5, 5, (0, 0)),
    ],
)
def test_cut(lines, fenced, longest, shortest, cut):
    assert section(lines, fenced).cut(longest, shortest) == cut


@pytest.mark.parametrize(
    "text, want",
    [
        ("", [(0, 1, 1, 0, "")]),
        ("# Title\n\n" + "hello world\n" * 200, [(1491, 1, 126, 1, "# Title"), (918, 126, 203, 1, "# Title")]),
        ("# A\nshort\n# B\nshort2", [(20, 1, 4, 2, "# B")]),
        ("# A\n" + "x" * 250 + "\n# B\ntail", [(254, 1, 2, 1, "# A"), (8, 3, 4, 2, "# B")]),
        ("x" * 4000, [(4000, 1, 1, 0, ""), (2501, 1, 1, 0, ""), (1002, 1, 1, 0, "")]),
        ("\n\n".join(f"p{i} " + "w" * 400 for i in range(6)), [(1213, 1, 5, 0, ""), (1214, 6, 11, 0, "")]),
        ("intro\n```\n# not heading\n```\n# Real\nbody", [(39, 1, 6, 1, "# Real")]),
    ],
)
def test_markdown(text, want):
    assert [p[2:] for p in markdown_pieces(text)] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .#\n`é", max_size=5000))
def test_strict_pieces_hold_the_text_once(text):
    pieces = markdown_pieces(text * 3, strict=True, longest=150, shortest=20)
    assert "".join(p[1] for p in pieces).replace("\n", "") == (text * 3).replace("\n", "")


def test_even_parts_as_sql_and_python(spark):
    body = "\n".join("x" * 80 for _ in range(38))[:3008]
    rows = spark.createDataFrame([(1, "abc", 2, 2), (2, body, 2, 42), (3, None, 1, 1), (4, "", 1, 1)], "id int, text string, a int, b int")
    got = [tuple(r) for r in chunking.fixed_split(rows, "text", "a", "b").orderBy("id", "part").select("id", "total_chars", "line_start", "line_end").collect()]
    want = [(1, 3, 2, 2), *((2, len(t), s, e) for t, s, e in chunking.even_parts(body, 2, 42)), (4, 0, 1, 1)]
    assert got == want
    assert [n for i, n, *_ in got if i == 2] == [1003, 1003, 1002]


def test_chunked_keeps_keys_and_takes_null_as_empty(spark):
    rows = spark.createDataFrame([("k", None, 1), ("m", "# H\ntext", 2)], "key string, text string, part int")
    got = [(r.key, r.part, r.text_content, r.section_title) for r in chunking.chunked(rows, "text", ["key", "part"]).orderBy("key").collect()]
    assert got == [("k", 1, "", ""), ("m", 2, "# H\ntext", "# H")]
    assert chunking.chunked(rows.limit(0), "text", ["key"]).count() == 0


def test_code_pieces_cover_all_lines():
    text = "\n\n".join(f"def f{i}():\n    return {i}\n    # {'y' * 300}" for i in range(20))
    pieces = code_pieces(text)
    assert all(p[2] <= 1500 for p in pieces) and len(pieces) > 3
    assert "".join(p[1] for p in pieces).replace("\n", "") == text.replace("\n", "")


def test_heading_as_of(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, [(1, "# A"), (5, "# B")]), (2, [])], "id int, h array<struct<line_no: int, title: string>>")
    got = rows.select("id", chunking.heading_at(F.col("h"), F.lit(4)).alias("t"), chunking.heading_at(F.col("h"), F.lit(9)).alias("u")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "# A", "# B"), (2, "", "")]
