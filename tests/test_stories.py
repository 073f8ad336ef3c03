"""Merging of threads, edges, and lookup of names on small tables."""

import pytest
from pyspark.sql import functions as F

from presswave.operators import edges, names, stories
from presswave.plans import threads

THREADS = "id int, status string, importance double, article_count long, updated int, keywords array<string>, nations array<string>"


def test_merge_moves_links_and_honours_ejections(spark):
    threads = spark.createDataFrame(
        [
            (1, "active", 5.0, 2, 10, ["Oil", " war"], ["US"]),
            (2, "active", 5.0, 3, 10, ["oil ", "peace", ""], ["us", "FR"]),
            (3, "cooling", 9.0, 0, 10, None, None),
            (4, "active", None, 9, 99, ["x"], []),
            (5, "active", 1.0, 1, 10, ["keep", "Keep"], ["DE"]),
            (6, "active", 1.0, 0, 10, ["a"], ["IT"]),
            (7, "active", 1.0, 0, 10, ["b"], ["IT"]),
        ],
        THREADS,
    )
    links = spark.createDataFrame([(1, 11, 0.5, True), (1, 12, 0.6, False), (2, 12, 0.9, True), (2, 13, 0.1, True), (2, 14, 0.2, False), (4, 13, 0.7, True), (5, 13, 0.3, True)], "thread_id int, article_id int, relevance double, is_anchor boolean")
    out = spark.createDataFrame([(3, 14), (3, 14), (1, 13)], "thread_id int, article_id int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "a int, b int")
    got, moved = stories.merge_threads(threads, links, out, pairs, F.lit(500))
    # 3 wins by importance; then 2 (articles), 1, and 4 without importance; article 14 was ejected from 3
    assert sorted(tuple(r) for r in moved.collect()) == [(3, 11, 0.5, False), (3, 12, 0.9, False), (3, 13, 0.1, False), (5, 13, 0.3, True)]
    rows = {r["id"]: tuple(r)[1:] for r in got.collect()}
    assert rows[3] == ("cooling", 9.0, 3, 500, ["oil ", "peace", " war", "x"], ["us", "FR"])
    assert rows[1] == ("dormant", 5.0, 0, 500, ["Oil", " war"], ["US"])
    assert rows[2][:2] == ("dormant", 5.0) and rows[4][:3] == ("dormant", None, 0)
    assert rows[5] == ("active", 1.0, 1, 10, ["keep", "Keep"], ["DE"])
    assert rows[6] == ("active", 1.0, 0, 500, ["a", "b"], ["IT"]) and rows[7][:3] == ("dormant", 1.0, 0)


def test_merge_without_pairs_changes_nothing(spark):
    threads = spark.createDataFrame([(1, "active", 5.0, 2, 10, ["a"], ["US"])], THREADS)
    links = spark.createDataFrame([(1, 11, 0.5, True)], "thread_id int, article_id int, relevance double, is_anchor boolean")
    got, moved = stories.merge_threads(threads, links, links.select("thread_id", "article_id").limit(0), spark.createDataFrame([], "a int, b int"), F.lit(500))
    assert [tuple(r) for r in got.collect()] == [(1, "active", 5.0, 2, 10, ["a"], ["US"])]
    assert [tuple(r) for r in moved.collect()] == [(1, 11, 0.5, True)]


def test_buckets_above_their_cap_form_no_pairs(spark):
    posts = spark.createDataFrame([("identity", "x", k) for k in range(61)] + [("identity", "y", k) for k in (1, 2, 2)] + [("title", "t", k) for k in (1, 2, 3)] + [("title", None, 9), ("title", None, 8), ("title", "one", 7)], "family string, key string, id int")
    assert sorted(tuple(r) for r in edges.hinted_pairs(posts).collect()) == [(1, 2, 4.15), (1, 3, 1.15), (2, 3, 1.15)]


def test_sparse_vectors(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    vectors = spark.createDataFrame([(1, "keyword", "a", 1.0), (1, "keyword", "b", 2.0), (2, "keyword", "b", 1.0), (2, "keyword", "c", 1.0), (3, "native", "a", 1.0)], "id int, kind string, term string, weight double")
    got = {r["b"]: (r["sim_keyword"], r["sim_native"]) for r in edges.vector_similarities(pairs, vectors).collect()}
    assert got == {2: (0.25, 0.0), 3: (0.0, 0.0)}


def test_edge_weight_by_hand(spark):
    thread = lambda k, **has: {"id": k, "category": "war", "importance": 9, "article_count": 12, "raw_hits": 1, "normalized_hits": 1, "identity": None, "countries": ["A"], "languages": ["x"], "title": ["t", "u"], "summary": ["t"]} | has
    kinds = "id int, category string, importance int, article_count int, raw_hits int, normalized_hits int, identity int, countries array<string>, languages array<string>, title array<string>, summary array<string>"
    rows = [thread(1), thread(2, category=None, countries=[], languages=["y"], title=["t", "v"]), thread(3, importance=1)]
    threads = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    vectors = spark.createDataFrame([(k, kind, "w", 1.0) for k in (1, 2, 3) for kind in edges.KINDS], "id int, kind string, term string, weight double")
    posts = spark.createDataFrame([("keyword", "w", k) for k in (1, 2, 3)], "family string, key string, id int")
    got = {(r["a"], r["b"]): r["weight"] for r in edges.edge_weights(threads, vectors, posts).collect()}
    same = 0.28 + 0.22 + 0.12 + 0.08 + 0.13 + 0.025 + 0.015 + 0.04 + 0.03 + 0.015
    assert got[1, 2] == pytest.approx(same, abs=1e-4) and got[1, 3] == 1.0
    best = edges.edge_weights(threads, vectors, posts, each=1)
    assert {(r["a"], r["b"]) for r in best.collect()} == {(1, 3), (1, 2)}


def test_names_by_trigram_and_alias(spark):
    entities = spark.createDataFrame(
        [(1, "Energy crisis 1979", ["oil shock"]), (2, "Energy crisis 2022", []), (3, "energy crisis", None), (4, None, ["Energy Crisis"]), (5, "Unrelated", ["x"])] + [(k, "common name", []) for k in range(100, 140)],
        "id int, name string, aliases array<string>",
    )
    asked = spark.createDataFrame([("energy crisis 2022",), ("OIL SHOCK",), ("common names",), ("",), (None,), ("energy crisis",), ("!!",)], "name string")
    got = {}
    for r in names.find_names(asked, entities).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append((r["id"], r["sim"], r["by_alias"], r["fits"]))
    assert set(got) == {"energy crisis 2022", "OIL SHOCK", "common names", "energy crisis"}
    assert [x[0] for x in got["common names"]] == [100, 101, 102, 103, 104]
    assert got["OIL SHOCK"] == [(1, 0.0, True, True)]
    assert (2, 1.0, False, True) == got["energy crisis 2022"][0] and [x[3] for x in got["energy crisis 2022"] if x[0] == 1] == [False]
    assert got["energy crisis"][0] == (3, 1.0, False, True) and (4, 0.0, True, True) in got["energy crisis"]


def test_similar_sets_lose_no_pair(spark):
    import random

    draw = random.Random(4)
    sets = {k: sorted({draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 12))}) for k in range(120)}
    df = spark.createDataFrame([(str(k), s) for k, s in sets.items()], "key string, s array<string>")
    got = {(r["a"], r["b"]) for r in names.similar_sets(df, df, 0.55).collect()}
    want = {(str(a), str(b)) for a, x in sets.items() for b, y in sets.items() if len({*x} & {*y}) / len({*x} | {*y}) >= 0.55}
    assert got == want


def test_earlier_stories_with_a_review_band(spark):
    from datetime import date

    rows = [(1, date(2024, 3, 1), list("abcd")), (2, date(2024, 3, 5), list("abce")), (3, date(2024, 5, 2), list("abcd")), (4, date(2024, 3, 5), list("axyz")), (5, date(2024, 3, 5), None), (6, date(2024, 3, 5), []), (7, date(2024, 3, 5), list("abcd"))]
    rows += [(20 + k, date(2024, 3, 4), list("abcd")) for k in range(8)]
    df = spark.createDataFrame(rows, "id int, seen date, keys array<string>")
    got = {}
    for r in stories.identity_candidates(df, df.withColumnRenamed("id", "identity")).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["identity"], r["likeness"], r["verdict"]))
    assert 1 not in got and 5 not in got and 6 not in got and 4 not in got
    assert got[2] == [(7, 0.6, "same")] + [(k, 0.6, "same") for k in range(20, 24)]
    assert got[7] == [(k, 1.0, "same") for k in range(20, 25)]
    assert got[21] == [(20, 1.0, "same")] + [(k, 1.0, "same") for k in range(22, 26)]
    # 60 days back from 2 May leave 4 and 5 March, not 1 March
    assert got[3] == [(7, 1.0, "same")] + [(k, 1.0, "same") for k in range(20, 24)]


def test_umbrella_links(spark):
    """Gate, caps, phrases of several words, attached and old articles, nulls and repeated rows."""
    lines = [(1, ["US"], ["k"], ["e1", "e2"], ["gaza"], ["west bank", "gaza"]), (2, [], [], [], [], []), (3, ["FR"], None, None, None, None)]
    lines = spark.createDataFrame(lines, "line long, nations array<string>, keywords array<string>, entities array<string>, title array<string>, phrases array<string>")
    rows = [
        (1, 9, "US", None, None, "nothing shared but the nation"), (2, 9, "DE", [], [], "On the West-Bank, today"), (3, 8, "DE", ["k"], ["e1"], "west of the bank"), (4, 8, None, ["k"], ["e9"], "no entity"), (5, 7, "US", ["k"], ["e1", "e2"], "Gaza"),
        (6, 1, "US", ["k"], ["e1"], "gaza, but old"), (7, 9, "US", ["k"], ["e1"], "gaza, but attached"), (8, 9, None, None, None, None), (9, 9, "FR", ["k2"], ["e"], "france"), (5, 7, "US", ["k"], ["e1", "e2"], "Gaza"),
    ]
    articles = spark.createDataFrame(rows, "article long, published int, nation string, keywords array<string>, entities array<string>, title string").distinct()
    attached = spark.createDataFrame([(1, 7), (1, 7)], "line long, article long")
    found = lambda **how: [(r["line"], r["article"], r["score"], r["by_phrase"]) for r in stories.umbrella_links(lines, articles, attached, F.lit(5), **how).orderBy("line", F.desc("score"), "article").collect()]
    assert found() == [(1, 5, 10.9, True), (1, 3, 3.5, False)]  # article 2 has a phrase alone: 2.0
    assert found(most=1) == [(1, 5, 10.9, True)]
    assert found(candidates=3) == [(1, 3, 3.5, False)]
    assert stories.umbrella_links(lines, articles.limit(0), attached, F.lit(5)).count() == 0


THREAD_SETS = "id long, category string, title array<string>, keys array<string>, nations array<string>"


def test_links_of_threads_broadcast_nothing_by_the_size_of_columns(spark):
    """Arrays made from short columns are larger than Spark takes them for: the sides of these joins are shuffled."""
    rows = [(k, None, [f"a{k // 2}", f"b{k // 2}", f"c{k // 2}"], [f"k{k // 2}", f"m{k // 3}"], ["x"]) for k in range(12)]
    df = threads.duplicate_links(spark.createDataFrame(rows, THREAD_SETS))
    assert sorted(tuple(r) for r in df.collect()) == [(k, k + 1) for k in range(0, 12, 2)]
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()


def test_a_common_key_forms_no_pairs_of_sets_that_cannot_be_alike(spark):
    rows = [(k, [f"x{k}", f"y{k}", f"z{k}", f"brand{k % 2}", "type"]) for k in range(80)]
    assert threads.alike_pairs(spark.createDataFrame(rows, "id long, s array<string>"), 0.4).count() == 0


def test_alike_pairs_lose_no_pair(spark):
    import random

    draw = random.Random(6)
    sets = {k: sorted({draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 12))}) for k in range(120)}
    df = spark.createDataFrame(list(sets.items()), "id long, s array<string>")
    for least in (0.4, 0.55):
        got = {(r["a"], r["b"]) for r in threads.alike_pairs(df, least).collect()}
        assert {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= least} <= got


def test_sets_of_stories_are_shuffled_by_hash(spark, monkeypatch):
    """The key that goes with each element of a set is short, however long the set's text is."""
    from datetime import date

    seen = {}
    whole = stories.similar_sets
    monkeypatch.setattr(stories, "similar_sets", lambda left, right, least: seen.update(kind=left.schema["key"].dataType.simpleString()) or whole(left, right, least))
    df = spark.createDataFrame([(k, date(2024, 3, k), ["word" * 9, "x" * 50]) for k in (1, 2)], "id int, seen date, keys array<string>")
    got = stories.identity_candidates(df, df.withColumnRenamed("id", "identity")).collect()
    assert [tuple(r) for r in got] == [(2, 1, 1, 1.0, "same")] and seen["kind"] == "binary"
