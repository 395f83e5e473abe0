import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from emberquill.operators import packed as P

CASES = [
    ("a, b", ["a", "b"]), ("a", ["a"]), ("", []), (" , ,", []), ("a||b|", ["a", "b"]), ('"a, b"; c', ["a, b", "c"]), ('"The ""Long"" Nap"|x', ['The "Long" Nap', "x"]),
    ('["a", "b, c"]', ["a", "b, c"]), ("“Left|Right”，x", ["Left|Right", "x"]), ("「火」、水", ["火", "水"]), ("Keeper's Calm/b-c", ["Keeper's Calm", "b-c"]), ("a\tb\nc", ["a", "b", "c"]),
    ('"a', ['"a']), ('"a"b, c', ['"a"b', "c"]), ("[a, b", ["[a", "b"]), ('"",a', ["a"]), ("[a, [b, c]]", ["a", "b", "c"]), ("a；b／c｜d", ["a", "b", "c", "d"]), ('"a" , "b"', ["a", "b"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_values(text, values):
    assert [v for v, _ in P.Grammar(text, False).parse()] == values


def test_blanks_separate_only_where_asked():
    assert [v for v, _ in P.Grammar("火　水 冰", True).parse()] == ["火", "水", "冰"]
    assert [v for v, _ in P.Grammar("Second Thaw", False).parse()] == ["Second Thaw"]
    assert [v for v, _ in P.Grammar('"火" 水', True).parse()] == ["火", "水"]


def test_errors_are_named():
    assert P.Grammar('"a, b', False).parse() == [('"a', "malformed_quote"), ("b", None)]
    assert P.Grammar("x; [a", False).parse()[1] == ("[a", "unclosed_list")


@pytest.mark.parametrize("text", ["[," * 10_000, "[" * 100_000 + "]" * 100_000, "[" * 100_000, "“a," * 50_000 + "”x", '"x""y,' * 50_000, '["a' * 50_000, "【[\"a\"]】," * 20_000])
def test_linear_in_the_length(text):
    start = time.perf_counter()
    P.Grammar(text, False).parse()
    assert time.perf_counter() - start < 1.0 * max(1, len(text) / 100_000)


def test_lists_beside_values():
    assert P.Grammar("[a], b", False).parse() == [("a", None), ("b", None)]
    assert P.Grammar("[a]b, c", False).parse() == [("[a]b", "unclosed_list"), ("c", None)]
    assert P.Grammar('["a", [“b】”, c]], 【d】', False).parse() == [(v, None) for v in ("a", "b】", "c", "d")]


@given(st.text(st.sampled_from('ab ,"“”[]【】'), max_size=24), st.booleans())
def test_no_letter_is_lost(text, loose):
    kept = "".join(v for v, _ in P.Grammar(text, loose).parse())
    assert [c for c in kept if c in "ab"] == [c for c in text if c in "ab"]


@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cc", "Z"), exclude_characters=',，、;；|｜/／"“”「」『』[]【】'), min_size=1), min_size=1), st.sampled_from(",;|"))
def test_round_trip_of_quoted_values(values, mark):
    text = mark.join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v for v, _ in P.Grammar(text, False).parse()] == values


def test_rows(spark):
    rows = spark.createDataFrame([(1, "a,b", None, "x"), (1, "a,b", "", "y"), (2, None, "q" * 100_000, "z")], "k long, f string, g string, pos string")
    out = P.split_values(rows, ["k"], ["f", "g"])
    assert sorted((r["k"], r["field"], r["pos"], r["val"][:3], r["values"]) for r in out.collect()) == [(1, "f", 1, "a", 2), (1, "f", 1, "a", 2), (1, "f", 2, "b", 2), (1, "f", 2, "b", 2), (2, "g", 1, "qqq", 1)]
    assert P.split_values(rows.limit(0), ["k"], ["f"]).count() == 0
