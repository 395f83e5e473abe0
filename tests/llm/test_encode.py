import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from emberquill.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.vocabulary()), reason="no vocabulary files")
TEXTS = [None, "", " ", "Hello, world", "火水電 🐾", "<|endoftext|>", "x" * 200_000, "é" + chr(0x301), "a\r\n\tb", chr(0)]


def test_ids_and_back(spark):
    rows = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "a", "q")], "k long, text string, ids string")
    ids = E.encode(rows, key="k")
    got = {r["k"]: r["ids"] for r in ids.collect()}
    assert got[0] == got[1] == [] and got[3] and max(got[5]) < 50256 and got[None]
    back = {r["k"]: r["text"] for r in E.decode(ids, key="k").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert E.encode(rows.limit(0), key="k").count() == 0


def test_same_as_the_other_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    import base64

    with open(E.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in TEXTS if t and len(t) < 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert {r["k"]: r["ids"] for r in E.encode(rows, key="k").collect()} == {i: other.encode_ordinary(t) for i, t in enumerate(texts)}


def test_offsets_cover_the_text(spark):
    rows = spark.createDataFrame([(1, "Hello 火 world")], "k long, text string")
    r = E.encode(rows, key="k", offsets=True).first()
    assert r["starts"][0] == 0 and r["ends"][-1] == len("Hello 火 world") and len(r["ids"]) == len(r["starts"]) == len(r["ends"])


@given(st.text())
def test_every_byte_has_a_letter(text):
    letters = E.byte_letters()
    assert len(letters) == 256 == len(set(letters.values()))
