import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberquill.llm import pieces as P

TEXTS = st.text(st.sampled_from("ab 。，.\n!火水電 c9"), max_size=900)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(20, 120), st.integers(0, 19))
def test_pieces_cover_the_text(text, limit, overlap):
    layout = P.Layout(text.strip())
    if not layout.text:
        return
    cuts = layout.cuts(limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(layout.text)
    assert all(0 < b - a <= limit for a, b, _ in cuts)
    assert all(later[0] == before[1] - overlap for before, later in zip(cuts, cuts[1:]))
    natural = sorted(e for ends in layout.ends for e in ends)
    assert not any(kind == "hard" and a + overlap < e <= a + limit for a, _, kind in cuts for e in natural)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.data())
def test_tokens_equal_a_plain_count(text, data):
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    plain = sum(-(-len(t) // 2) if t[0] > "z" else 1 for t in P.TOKEN.findall(text[a:b].lower()))
    assert P.Layout(text).tokens(a, b) == plain


def test_natural_boundaries_come_first():
    text = "a" * 60 + "。" + "b" * 30 + "，" + "c" * 60
    assert P.Layout(text).cuts(100, 10)[0] == (0, 61, "1")
    assert P.Layout("x" * 250).cuts(100, 10)[0] == (0, 100, "hard")
    assert P.Layout("a" * 200 + ". " + "b" * 1000).cuts(500, 80)[:2] == [(0, 202, "1"), (122, 622, "hard")]
    assert P.Layout("火" * 221 + "。" + "水" * 400).cuts(500, 80) == [(0, 222, "1"), (142, 622, "end")]
    assert P.Layout("a" * 80 + "\n" + "b" * 600).cuts(500, 80)[0] == (0, 81, "0") and P.Layout("a" * 79 + "\n" + "b" * 600).cuts(500, 80)[0] == (0, 500, "hard")


def test_split_defined_cases(spark):
    rows = spark.createDataFrame([("a", None, "q"), ("b", "", "q"), ("c", " \n ", "q"), ("d", " short ", "q"), (None, "x" * 501, "q"), ("e", "长" * 200_000, "q"), ("d", " short ", "q")], "id string, content string, boundary string")
    got = P.split(rows).collect()
    assert [r["content"] for r in got if r["id"] == "d"] == ["short", "short"]
    assert sorted({r["id"] or "" for r in got}) == ["", "d", "e"] and max(r["char_count"] for r in got) == 500
    assert P.split(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.split(rows, limit=100, overlap=100)
    assert all(r['char_count'] <= 100 for r in P.split(rows, limit=100, overlap=99).where('id is null').collect())


def test_audit(spark):
    docs = spark.createDataFrame([("cut", "x" * 501), ("short", " " * 600 + "x"), ("null", None), ("ok", "y" * 501)], "id string, content string")
    piece = lambda no, i, d, k, c, w=None, n=None: (no, i, d, k, c, c, len(c) if n is None else n, len(c.split()) if w is None else w)
    pieces = spark.createDataFrame(
        [
            piece(1, "p1", "ok", 0, "y" * 100), piece(2, "p2", "ok", 1, "y" * 120), piece(9, "p2", "ok", 5, "zzz"),
            piece(3, "p3", "over", 0, "a" * 501), piece(4, "p4", "gap", 0, "a"), piece(5, "p5", "gap", 2, "a"), piece(6, "p6", "lap", 0, "abc"), piece(7, "p7", "lap", 1, "bcd"),
            piece(8, "p8", "count", 0, "a b", n=9), piece(10, "p9", "words", 0, "a b", w=1), (11, "p10", "nulls", None, None, None, None, None), (12, "p11", None, 0, "a", "a", 1, 1), piece(13, "p12", "one", 1, "a"),
        ],
        "chunk_no long, id string, document_id string, chunk_index int, content string, lexical_text string, char_count int, token_count int",
    )
    got = sorted((r["document_id"], r["defect"]) for r in P.audit(docs, pieces).collect())
    assert got == [("count", "char_count"), ("cut", "uncut"), ("gap", "gap"), ("lap", "overlap"), ("nulls", "char_count"), ("nulls", "gap"), ("nulls", "token_count"), ("one", "gap"), ("over", "over_limit"), ("words", "token_count")]
    assert P.audit(docs.limit(0), pieces.limit(0)).count() == 0
