"""Building blocks on hand-checked rows."""

import os
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswave import storage
from presswave.functions import scoring, text
from presswave.functions.expressions import row_key
from presswave.operators import phrases, relational, rerank
from presswave.operators.components import connected_components, extended_components
from presswave.plans import enrichment, threads
from presswave.sources import parsers, selection


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (2, 3), (5, 6), (9, 9), (7, None)], "u long, v long")
    assert rows(connected_components(edges).select("node", "component")) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9)]


def test_components_of_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([], "u long, v long"))) == []


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r[1] for r in rows(connected_components(edges).select("node", "component"))} == {0}


def test_set_measures(spark):
    one = spark.range(1).select(
        text.jaccard(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde"))).alias("j"),
        text.containment(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde"))).alias("c"),
        text.weighted_jaccard(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("b"), F.lit(1.0), F.lit("c"), F.lit(1.0))).alias("w"),
        F.array_sort(text.trigrams(F.lit("cat"))).alias("t"),
    ).first()
    assert one["j"] == 2 / 5 and one["c"] == 2 / 3 and one["w"] == 0.25 and one["t"] == ["  c", " ca", "at ", "cat"]


def test_scores(spark):
    one = spark.range(1).select(
        scoring.decay(F.lit(24.0)).alias("d"), scoring.decay(F.lit(240.0)).alias("f"), scoring.relevance(F.lit(10.0), F.lit(36.0)).alias("r"),
        scoring.momentum(F.lit(6), F.lit(14)).alias("m"), scoring.momentum(F.lit(4), F.lit(0)).alias("n"), (4 * scoring.member_weight(F.lit(32))).alias("w"),
        scoring.rule_confidence(F.lit(2.0), F.lit(0.5)).alias("c"), text.number(F.lit("−1,234.5[2] (est.)")).alias("x"),
    ).first()
    assert (one["d"], one["f"], one["r"], one["m"], one["n"], one["w"], one["x"]) == (0.5, 0.05, 0.3679, 2.0, 40.0, 0.4375, -1234.5)
    assert abs(one["c"] - 0.751) < 1e-3


def test_folding(spark):
    one = spark.createDataFrame([("Éléphant “X” – 漢字's",), (None,)], "t string").select(text.fold("t").alias("a"), text.fold_keyword("t").alias("b")).collect()
    assert one[0]["a"] == "elephant x s" and one[0]["b"] == "elephant x 漢字s" and one[1]["a"] is None


def test_band_join(spark):
    a = spark.createDataFrame([(1, 10), (2, 95)], "a long, x long")
    b = spark.createDataFrame([(7, 19), (8, 21), (9, 100)], "b long, y long")
    assert rows(relational.band_join(a, b, "x", "y", 10).select("a", "b")) == [(1, 7), (2, 9)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = relational.upsert(old, new, ["k"])
    assert rows(once) == rows(relational.upsert(once, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(relational.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]


def test_working_tables_can_be_dropped(spark, tmp_path):
    before, storage._made[:] = list(storage._made), []
    table = storage.materialize(spark.range(3), "some", 2)
    path = storage._made[0].removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(path) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert storage.drop_working_tables(spark) == 1 and not os.path.exists(path)
    storage._made[:] = before


def test_rerank_rests_sources(spark):
    df = spark.createDataFrame([(1, k, k % 3, float(20 - k)) for k in range(9)], "feed int, id long, src long, score double")
    order = [r["src"] for r in rerank.diversity_rerank(df, "feed", "score", "id", "src", cooldown=3).orderBy("place").collect()]
    assert all(len(set(order[i : i + 3])) == 3 for i in range(len(order) - 2))


def test_variance_rerank_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    start = datetime(2024, 1, 1)
    rows = [(k % 2, k, int(rng.integers(0, 4)), float(rng.integers(1, 30)), start + timedelta(hours=int(rng.integers(0, 50)))) for k in range(80)] + [(7, 900 + k, 1, 2.0, start) for k in range(4)]
    got = {}
    for r in rerank.variance_rerank(spark.createDataFrame(rows, "feed int, id long, land long, score double, at timestamp"), "feed", "score", "id", "land", "at").collect():
        got.setdefault(r["feed"], []).append((r["place"], r["id"]))
    for feed in (0, 1, 7):
        left, fines, want = sorted((r for r in rows if r[0] == feed), key=lambda r: (-r[3], r[1])), {}, []
        newest, span = max(r[4] for r in left), max(r[4] for r in left) - min(r[4] for r in left)
        while left:
            blocked = want[-1][2] if len(want) >= 2 and want[-1][2] == want[-2][2] else None
            able = [r for r in left if r[2] != blocked]
            value = lambda r: r[3] * (1 + 0.5 * (1 - ((newest - r[4]) / span if span else 0))) * (1 - fines.get(r[2], 0))  # noqa: B023, E731
            pick = max(able, key=value) if able else left[0]
            left.remove(pick)
            want.append(pick)
            fines = {k: v * 0.75 for k, v in fines.items() if v * 0.75 >= 0.01}
            fines[pick[2]] = min(1.5, fines.get(pick[2], 0) + 1.5)
        assert [i for _, i in sorted(got[feed])] == [r[1] for r in want]


def test_rerank_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(f), k, int(s), float(v)) for k, (f, s, v) in enumerate(zip(rng.integers(0, 3, 120), rng.integers(0, 5, 120), rng.integers(0, 40, 120)))]
    got = {}
    for r in rerank.diversity_rerank(spark.createDataFrame(rows, "feed int, id long, src long, score double"), "feed", "score", "id", "src", cooldown=3).collect():
        got.setdefault(r["feed"], []).append((r["place"], r["id"]))
    for feed in range(3):
        left, wait, want = sorted((r for r in rows if r[0] == feed), key=lambda r: (-r[3], r[1])), {}, []
        while left:
            wait = {k: v - 1 for k, v in wait.items() if v > 1}  # every slot counts down all sources that rest
            free = [r for r in left if r[2] not in wait]
            pick = free[0] if free else min(left, key=lambda r: (wait[r[2]], -r[3]))  # noqa: B023
            wait[pick[2]] = 3
            want.append(pick[1])
            left.remove(pick)
        assert [i for _, i in sorted(got[feed])] == want


def test_combined_rerank_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    start = datetime(2024, 1, 1)
    rows = [(1, k, int(rng.integers(0, 9)), int(rng.integers(0, 4)), float(rng.integers(1, 30)), start + timedelta(hours=int(rng.integers(0, 50)))) for k in range(60)]
    got = [r["id"] for r in rerank.combined_rerank(spark.createDataFrame(rows, "feed int, id long, src long, land long, score double, at timestamp"), "feed", "score", "id", "src", "land", "at").orderBy("place").collect()]
    newest, oldest = max(r[5] for r in rows), min(r[5] for r in rows)
    left, wait, fines, want, n = sorted(rows, key=lambda r: (-r[4], r[1])), {}, {}, [], len(rows)
    while left:
        wait = {k: v - 1 for k, v in wait.items() if v > 1}
        value = lambda r: r[4] * (1.5 - 0.5 * ((newest - r[5]) / (newest - oldest))) * (1 - fines.get(r[3], 0))  # noqa: B023, E731
        free = [r for r in left if r[2] not in wait and not (want and want[-1][3] == r[3])]
        pick = max(free, key=value) if free else min(left, key=lambda r: (wait.get(r[2], 0), -value(r)))  # noqa: B023
        left.remove(pick)
        want.append(pick)
        wait[pick[2]] = n
        fines = {k: v * 0.85 for k, v in fines.items() if v * 0.85 >= 0.01}
        fines[pick[3]] = 2.0
    assert got == [r[1] for r in want]


def test_cities_are_spread(spark):
    kept, late = rerank.city_window([True, True] + [False] * 25 + [True, True], 20, 1)
    assert kept == [0, *range(2, 28)] and late == [1, 28]
    df = spark.createDataFrame([(1, k, k, k < 3, 10.0 - k / 1e5, datetime(2024, 1, 1) + timedelta(hours=k)) for k in range(6)], "feed int, id long, src long, city boolean, score double, at timestamp")
    got = [r["id"] for r in rerank.rank_feed(df, "feed", "score", "id", "src", "city", "at").orderBy("place").collect()]
    assert got[:1] == [0] and sorted(got) == list(range(6)) and set(got[-2:]) == {1, 2}


def test_tokens_of_scripts_without_spaces(spark):
    df = spark.createDataFrame([("東京 都", "ja"), ("ab", "th"), ("x", "zh"), (None, "ja"), ("«Héllo», wörld - it's 12", "en"), ("a b", None)], "t string, lang string")
    got = [r["k"] for r in df.select(enrichment.tokenised(F.col("t"), F.coalesce("lang", F.lit(""))).alias("k")).collect()]
    assert got == [["東京", "東京都", "京都"], ["ab"], [], [], ["héllo", "wörld", "it's"], []]


def test_phrases_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "Peace talks\nno peace, peace talks. peacetime", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    table = phrases.Phrases.of(spark.createDataFrame([(1, "peace", False, 1.0), (1, "peace talks", True, 2.0)], "tag int, phrase string, is_phrase boolean, base double"))
    got = {r["phrase"]: (r["words"], round(r["hits"], 6)) for r in phrases.phrase_hits(enrichment.titled(docs), table).collect()}
    assert got == {"peace": (7, 3.8), "peace talks": (7, 2.8)}


def test_selectors():
    page = selection.read_page("""<body><div id=a class="x y"><p>one<p>two <a href=/1>first</a><ul><li>a<ul><li>b</ul><li>c</ul></div>
        <section><div class=y data-k="v w"><a href='/2'>sec<b>ond</b></a></div></section><img class=y><div class=y>no link</div>""")
    found = lambda q: [x.text() for x in selection.select(page, selection.parse_selector(q))]
    assert found("p") == ["one", "two first a b c"]
    assert found("div.x.y a") == ["first"] and found("#a > a") == [] and found("section > div > a") == ["second"]
    assert found("[data-k~=w] b, li li") == ["b", "ond"]
    assert found("a[href^='/2']") == ["second"] and found("a[href$=1]") == ["first"] and found("*[data-k*='v w']") == ["second"]
    assert found("body div li") == ["a b", "b", "c"] and found("body > li") == []
    assert selection.links_of(page, selection.parse_selector(".y")) == [("/1", "first"), ("/2", "second")]
    for bad in ("", "a >", "a, ", "..x", "a:hover"):
        with pytest.raises(ValueError):
            selection.parse_selector(bad)


def test_tables_of_pages(spark):
    page = """<table><tr><td>Info</td><td>5</td></tr></table>
      <table><tr><th>Rank<th>Country<th>Height (m)<th>Depth</tr>
      <tr><td>1<td><a href=/f>France</a> [1]<td>4,806 12 m<td>−5</tr>
      <tr><td>2<td>Peru<td>n.d.<td>1<tr><td>3<td><a></a><td>7<td>2<tr><td>4<td>Oman <table><tr><td>no</td></tr></table><td>3,000 (est.)<td>1,000</table>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table>"), (None, page)], "id int, html string")
    got = lambda *a, **k: sorted((str(r["id"]), r["name"], r["value"]) for r in parsers.table_values(df, "id", "html", *a, **k).collect())
    both = lambda rows: sorted([("1", *r) for r in rows] + [("None", *r) for r in rows])
    assert got("country", "height") == both([("France", 4806.0), ("Oman", 3000.0)])
    assert got("The Country", ("height", "m"), "depth", "a - b") == both([("France", 4811.0), ("Oman", 2000.0)])
    assert got(None, "depth") == both([("France", -5.0), ("Peru", 1.0), ("Oman", 1000.0)])
    assert got("country", "height", nth=0) == [] and got("country", "width") == []
    nested = selection.table_cells(df.filter("id = 1"), "id", "html").filter("nth = 2").collect()
    assert [[c["text"] for c in r["cells"]] for r in nested] == [["no"]]


def test_feeds_of_all_kinds(spark):
    feeds = [
        (1, '<feed><entry><title>t</title><link rel="enclosure" href="/e.mp3"/><link rel="alternate" href="/page"/><updated>u</updated></entry><entry><title>s</title><link rel="self" href="/s"/><published>p</published></entry></feed>'),
        (2, '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>c</title></channel><item><title>old</title><link>/o</link><dc:date>2001</dc:date></item></rdf:RDF>'),
        (3, "<rss><channel><item><title>n</title><link>/n</link><pubDate>d</pubDate></item></channel></rss>"),
        (4, "not xml"), (5, None),
    ]
    got = sorted(tuple(r) for r in parsers.feed_items(spark.createDataFrame(feeds, "id int, xml string"), "id", "xml").collect())
    assert got == [(1, "s", "/s", "p"), (1, "t", "/page", "u"), (2, "old", "/o", "2001"), (3, "n", "/n", "d")]


def test_row_key_of_nested_maps(spark):
    df = spark.createDataFrame([(1, [{"a": 1}], ({"b": 2},)), (1, [{"a": 2}], ({"b": 2},)), (1, None, None)], "x int, m array<map<string,int>>, s struct<n: map<string,int>>")
    assert len({r[0] for r in df.select(row_key(df)).collect()}) == 3


def test_parsers_take_what_does_not_parse(spark):
    feeds = spark.createDataFrame([(1, "<rss><channel><item><title>A</title><link>l</link></item></channel></rss>"), (2, "no xml <"), (3, None), (4, "<rss><channel/></rss>")], "id int, xml string")
    assert [tuple(r) for r in parsers.feed_items(feeds, "id", "xml").collect()] == [(1, "A", "l", None)]
    pages = spark.createDataFrame([(1, "<ul><li><a href=x>One <b>1</b></a><li><a>none</a><a href='y'>Two</a></ul><a href=z>out</a>"), (2, None), (3, "<li><a href=q>open")], "id int, html string")
    assert [tuple(r) for r in parsers.html_links(pages, "id", "html").collect()] == [(1, 0, "x", "One 1"), (1, 1, "y", "Two")]
    tables = spark.createDataFrame([(1, "<table><tr><th>Country<th>GDP</table>"), (2, "<table><tr><th>Country name</th><th>GDP (US$)</th></tr><tr><td>X</td><td>1,200[3]</td></tr><tr><td>Y</td><td>n/a</td></tr><tr><td>Z</td></tr></table>"), (3, None)], "id int, html string")
    assert [tuple(r) for r in parsers.table_values(tables, "id", "html", ("country",), ("gdp",)).collect()] == [(2, "X", 1200.0)]
    answers = spark.createDataFrame([(1, '{"a": {"b": [{"t": {"m": "x"}}, {"t": 3}]}}'), (2, "{"), (3, None)], "id int, j string")
    assert [tuple(r) for r in parsers.json_items(answers, "id", "j", "a.b", {"m": "t.m"}).collect()] == [(1, 0, "x"), (1, 1, None)]


def test_duplicate_links_by_rare_words(spark):
    rng = np.random.default_rng(4)
    rows = [(k, ["politics", "sports", None][k % 3], [f"t{x}" for x in set(rng.integers(0, 12, 5).tolist())] + ["common"], [f"k{x}" for x in set(rng.integers(0, 6, 3).tolist())], [f"n{rng.integers(0, 3)}"]) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, category string, title array<string>, keys array<string>, nations array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and (None in (x[1], y[1]) or x[1] == y[1]):
                t, k, n = len(set(x[2]) & set(y[2])), jac(x[3], y[3]), set(x[4]) & set(y[4])
                if t >= 3 and (jac(x[2], y[2]) >= 0.4 or t / min(len(x[2]), len(y[2])) >= 0.55) or k >= 0.55 or n and t >= 3 and (jac(x[2], y[2]) >= 0.3 or k >= 0.35):
                    want.add((x[0], y[0]))
    assert {tuple(r) for r in threads.duplicate_links(df).collect()} == want and want


def test_components_grow_by_edges(spark):
    labels = connected_components(spark.createDataFrame([(1, 2), (5, 6)], "u long, v long"))
    got = rows(extended_components(labels, spark.createDataFrame([(6, 2), (9, 8), (1, 2)], "u long, v long")).select("node", "component"))
    assert got == [(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
    assert rows(extended_components(labels, spark.createDataFrame([], "u long, v long")).select("node", "component")) == [(1, 1), (2, 1), (5, 5), (6, 5)]


def test_a_long_text_is_split_once(spark):
    df = spark.createDataFrame([(" ".join(f"word{k % 700}" for k in range(20_000)),)], "t string")
    began = time.time()
    assert df.select(F.size(text.bigrams(text.word_list(F.col("t"))))).first()[0] == 19_999
    assert time.time() - began < 20
