"""Goldens of catalogue contracts, index states, reports, templates and reranking."""

import pytest
from pyspark.sql import functions as F

from emberquill.functions import text as T
from emberquill.operators import catalog as C
from emberquill.operators import evaluation as E
from emberquill.operators import explain as X
from emberquill.operators import merge as M
from emberquill.operators import scoring as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def children(spark):
    return (
        table(spark, [(1, "火狐", "Fox", None, "g", None, "Unknown"), (2, "木", "Wood", "c", None, "cave", None)], "entity_id long, name_zh string, name_en string, category_zh string, genus string, habitat string, hidden_ability string"),
        table(spark, [(1, 2, "ice"), (1, 1, "fire")], "entity_id long, slot int, code string"),
        table(spark, [("fire", "Fire", "火"), ("ice", "Ice", "冰")], "code string, name_en string, name_zh string"),
        table(spark, [(1, "csv:description_zh", "d"), (2, "flavor_text_en", "f")], "entity_id long, source_key string, content string"),
        table(spark, [(1, "sprite", "s", False, 5), (1, "artwork", "a", True, 9), (2, "b", "x", False, 2), (2, "b", "y", None, 1)], "entity_id long, image_kind string, image_url string, is_primary boolean, image_id long"),
    )


def test_contract_and_metadata(children):
    e, bridge, types, descriptions, images = children
    rows = {r["entity_id"]: r.asDict() for r in C.contract(e, bridge, types, descriptions, images).collect()}
    assert rows[1] == {"entity_id": 1, "name_zh": "火狐", "name_en": "Fox", "category_zh": "", "genus": "g", "habitat": "Unknown", "hidden_ability": "Unknown", "type_zh": "火, 冰", "type_1": "Fire", "type_2": "Ice", "description_zh": "d", "flavor_text_en": "", "analysis_text": "", "image_url": "a", "sprite_url": "s"}
    assert (rows[2]["type_1"], rows[2]["type_zh"], rows[2]["habitat"], rows[2]["flavor_text_en"]) == ("Unknown", "", "cave", "f")
    meta = {r["entity_id"]: tuple(r)[1:] for r in C.metadata(e, bridge, types, images).collect()}
    assert meta == {1: ("火狐", "Fox", "", "g", "火, 冰", "Fire", "Ice", "a", "s"), 2: ("木", "Wood", "c", "", "", "", "", "", "")}


def test_primary_images_first(children):
    got = [(r["entity_id"], r["image_url"]) for r in C.image_order(children[4]).orderBy("entity_id", "place").collect()]
    assert got == [(1, "a"), (1, "s"), (2, "y"), (2, "x")]


def test_state_and_filters(spark, children):
    state = table(spark, [(7,)], "revision long")
    assert {r["revision"] for r in C.with_state(children[0], state, "revision").collect()} == {7}
    with pytest.raises(ValueError, match="no row"):
        C.with_state(children[0], state.limit(0), "revision")
    rows = table(spark, [(1, " Ａlice ", 3), (2, "bob", 5), (3, None, None)], "k int, who string, n int")
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert ids(C.filtered(rows, folded={"who": "ALICE"})) == [1] and ids(C.filtered(rows, between={"n": (4, None)})) == [2] and ids(C.filtered(rows, equal={"k": None}, between={"n": (3, 5)})) == [1, 2]


def test_index_states(spark):
    chunks = table(spark, [("c1", "d1", "h"), ("c2", "d1", "h"), ("c3", "d2", "h"), ("c4", "d3", "h"), ("c5", "d3", "h")], "chunk_id string, document_id string, content_hash string")
    embedded = table(spark, [("c1", "ready", True, "h", None), ("c2", "ready", True, "h", None), ("c3", "ready", True, "old", None), ("c4", "failed", False, None, "first"), ("c5", "failed", False, None, "last")], "chunk_id string, status string, has_vector boolean, content_hash string, last_error string")
    states = M.embedding_states(chunks, embedded)
    assert {r["document_id"]: tuple(r)[1:] for r in states.collect()} == {"d1": (2, 2, 0, None), "d2": (1, 0, 0, None), "d3": (2, 0, 2, "last")}
    documents = table(spark, [("d1", 1, "a", 1, True, "ready", "x"), ("d2", 1, "b", 1, True, "ready", "old"), ("d3", 1, "b", 2, False, "ready", "y"), ("d4", 2, "profile", 1, True, "ready", "z")], "id string, entity_id long, source_key string, version int, is_current boolean, status string, content_hash string")
    descriptions = table(spark, [(1, "a", "x"), (1, "b", "y"), (1, "c", "q")], "entity_id long, source_key string, content_hash string")
    sources = M.source_states(descriptions, documents, states)
    assert {(r["entity_id"], r["source_key"]): (r["status"], r["current_id"], r["staged_id"]) for r in sources.collect()} == {(1, "a"): ("ready", "d1", None), (1, "b"): ("failed", "d2", "d3"), (1, "c"): ("unindexed", None, None), (2, "profile"): ("stale", "d4", None)}
    assert {r["entity_id"]: r["status"] for r in M.entity_states(table(spark, [(1,), (2,), (3,)], "entity_id long"), sources).collect()} == {1: "failed", 2: "stale", 3: "unindexed"}


def test_chunks_follow_a_new_split(spark):
    stored = table(spark, [("a", "d", True, "ready"), ("b", "d", True, "ready"), ("c", "d", False, "stale"), ("x", "other", True, "ready")], "id string, document_id string, is_current boolean, status string")
    wanted = table(spark, [("a", "d"), ("c", "d"), ("n", "d")], "id string, document_id string")
    got = {r["id"]: tuple(r)[1:] for r in M.synchronise_chunks(stored, wanted).collect()}
    assert got == {"a": ("d", True, "ready", "refresh"), "b": ("d", False, "stale", "retire"), "c": ("d", True, "ready", "refresh"), "n": ("d", True, "ready", "insert"), "x": ("other", True, "ready", "untouched")}


def test_same_outputs(spark):
    rows = lambda *x: table(spark, x, "q int, rank int, item int, s double")
    a = rows((1, 1, 5, 0.5), (1, 2, 6, None), (2, 1, 5, 0.5), (3, 1, 5, 0.5))
    b = rows((1, 1, 5, 0.5 + 1e-9), (1, 2, 6, None), (2, 1, 7, 0.6), (3, 1, 5, 0.5), (3, 2, 6, 0.1))
    assert {r["q"]: tuple(r)[1:] for r in E.same_outputs(a, b, "q", "item", ["s"]).collect()} == {1: (True, True), 2: (False, False), 3: (False, False)}


def test_whole_groups_and_reranking(spark):
    rows = table(spark, [(1, i, 0.9 - i / 10) for i in range(3)] + [(2, i, 0.9) for i in range(2)], "g int, i int, total double")
    order = [F.desc("total"), F.asc("i")]
    assert S.final_order(rows.where("g = 1"), "g", order, 3, whole=True).count() == 3
    with pytest.raises(Exception, match="fewer than 3 candidates for 2"):
        S.final_order(rows, "g", order, 3, whole=True).collect()

    def predictor(pairs):
        if any(t == "bad" for _, t in pairs):
            raise RuntimeError("model")
        return [float(len(t)) for _, t in pairs]

    texts = table(spark, [(1, 1, 0.5, "q", "a"), (1, 2, 0.4, "q", "bbbb"), (1, 3, 0.3, "q", None), (2, 1, 0.5, "q", "bad"), (2, 2, 0.4, "q", "bad"), (2, 3, 0.3, "q", "bad")], "g int, pos int, total double, query string, text string").coalesce(1)
    raw = S.predicted(texts, "query", "text", predictor, batch=3)
    assert [r["raw"] for r in raw.orderBy("g", "pos").collect()] == [1.0, 4.0, 0.0, None, None, None]
    ranked = S.rerank(raw, "g", "pos", "total", "raw", weight=0.5, limit=10)
    assert [r["total"] for r in ranked.where("g = 2").orderBy("rank").collect()] == [0.5, 0.4, 0.3] and ranked.where("g = 2 and reranker is not null").count() == 0
    assert [r["text"] for r in ranked.where("g = 1").orderBy("rank").collect()][0] == "bbbb"


def test_explanations(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    text = one(spark, X.local_text(F.lit(" 小火 "), a("冷靜", "冷 靜", "calm"), a("冷靜", "勇敢"), F.lit("喜歡夥伴。"), F.lit("INFP")))
    assert text == "你的描述呈現出冷靜的個性傾向。你選填的 INFP 也作為配對參考。小火圖鑑資料呈現出喜歡夥伴，整體帶有冷靜、勇敢的特質。你的描述與牠的資料都提到冷靜，這是這次配對的相似之處。"
    text = one(spark, X.local_text(F.lit(""), a(), a(), F.lit(""), F.lit(None).cast("string")))
    assert text == "這次以你的個性描述比較寶可夢的行為資料。這隻寶可夢目前可引用的資料以外文為主，詳細行為請參考下方證據。這份結果是行為與文字關聯的參考，你可以對照證據判斷是否符合自己的感受。"
    text = one(spark, X.daily_text(F.lit("小火"), F.lit("獅子座"), a("自信"), a("甲", "乙"), F.lit(""), a("勇敢")))
    assert text == "今天的獅子座訊號偏向自信。乙替這段節奏加入另一層參考。小火帶有勇敢的性格特質。兩者在今日的節奏上形成呼應，因此成為這個時辰的代表寶可夢。"
    assert one(spark, X.entity_tag(F.lit("database"), F.lit("v1"), F.lit(3), F.lit("0123456789abcdef99"))) == '"database-v1-r3-0123456789abcdef"'
    assert one(spark, X.daily_query(F.lit("獅子座"), F.lit("2026-01-02"), F.lit("冬月十四"), F.lit("小寒"), F.lit("子"), a("自信"), a("fire"))) == "今日獅子座代表寶可夢 國曆2026-01-02 農曆冬月十四 小寒子時 自信 fire"
    allowed = table(spark, [(1, ["a"])], "e int, evidence_ids array<string>")
    wide = table(spark, [(1, "這隻寶可夢總是照顧夥伴也喜歡安靜的樹林ＩＮＴＪ", ["a"], None)], "e int, text string, citations array<string>, selected string")
    assert [r["problem"] for r in X.problems(wide, allowed, "e").collect()] == ["foreign_code"]


def test_client_keys(spark):
    key = lambda c, k: one(spark, T.client_key(F.lit(c), k))
    assert key("1.2.3.4", "k") == key("1.2.3.4", "k") != key("1.2.3.4", "other") and key("1.2.3.5", "k") != key("1.2.3.4", "k") and len(key("x", "k")) == 32


def test_summary_without_its_label(spark):
    assert one(spark, T.chinese_summary(F.lit("【中文圖鑑描述：喜歡和夥伴一起生活。】"))) == "喜歡和夥伴一起生活。"


def test_feedback_is_checked_and_merged(spark):
    from emberquill.operators import feedback as B

    items = table(spark, [(1, 5, 1), (1, 6, 2), (2, 5, 1)], "impression_id long, item_id long, rank int")
    stored = table(spark, [(1, 5, 1, "match", "no_reason")], "impression_id long, item_id long, rank int, verdict string, reason string")
    new = table(spark, [(1, 5, 1, "not_match", "wrong_type"), (1, 6, 1, "match", "no_reason"), (2, 5, 1, "match", "no_reason"), (2, 9, 1, "match", "no_reason")], stored.schema)
    got = {(r["impression_id"], r["item_id"]): (r["verdict"], r["action"]) for r in B.upserted(stored, new, items).collect()}
    assert got == {(1, 5): ("not_match", "update"), (2, 5): ("match", "insert")}
    bad = table(spark, [(1, 5, 1), (1, 6, 1), (2, 5, 4), (3, 7, 1), (2, 5, 2)], "impression_id long, item_id long, rank int")
    impressions = table(spark, [(1,), (2,)], "impression_id long")
    assert sorted(map(tuple, B.shown(impressions, bad).collect())) == [(1, "repeated_rank"), (2, "rank"), (2, "repeated_item"), (3, "unknown_impression")]


def test_searches_are_measured(spark):
    from emberquill.operators import retrieval as R

    v = table(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id")
    m = R.measured(lambda one: R.dense_topk(v, one, 5), q, R.dense_topk(v, q, 5), samples=3, warm=1)
    assert m["samples"] == 3 and m["recall"] == 1.0 and m["p95_ms"] >= m["p50_ms"] > 0 and R.measured(lambda one: one, q.limit(0), q)["samples"] == 0
