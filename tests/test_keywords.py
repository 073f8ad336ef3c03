"""Keywords of documents, and clusters and identities made from them, against brute force."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from presswave.functions import text
from presswave.operators.names import similar_sets
from presswave.plans import enrichment, graphs


def test_most_frequent(spark):
    rng = random.Random(1)
    rows = [(0, []), (1, None), (2, ["b", "a", "b", "a", "c"]), (3, ["x"]), *((k, rng.choices("abcdefg", k=rng.randrange(60))) for k in range(4, 40))]
    got = spark.createDataFrame(rows, "id int, w array<string>").select("id", text.most_frequent(F.col("w"), 3).alias("m")).collect()
    for (_, words), row in zip(rows, sorted(got, key=lambda r: r["id"]), strict=True):
        want = sorted(Counter(words or []).items(), key=lambda e: (-e[1], e[0]))[:3]
        assert [(e["word"], -e["down"]) for e in row["m"]] == want


def test_keywords_of_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "... -- !!", "en"), (4, "«One» two-three, (one)\nfour four -- one?", None), (5, "One\n" + "long " * 30_000, "en")]
    docs = enrichment.titled(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    got = {}
    for r in enrichment.extracted_keywords(docs, ("the",)).collect():
        got.setdefault(r["doc_id"], {})[r["keyword"]] = r["frequency"]
    assert set(got) == {4, 5}
    assert got[4] == {"one": 7, "two-three": 3, "four": 2, "one two-three": 3, "two-three one": 3, "four four": 1, "four one": 1}
    assert got[5] == {"one": 3, "long": 30_000, "long long": 29_999}
    assert enrichment.extracted_keywords(docs.limit(0), ("the",)).count() == 0


def components(nodes, edges):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_linked_by_keys_connects_what_pairs_connect(spark):
    """With copies, unique keys, a key that all hold and nulls; no choice of keys forms pairs of nodes."""
    rng = random.Random(3)
    held = {n: {"all", f"own{n}", *rng.sample([f"k{i}" for i in range(25)], rng.randrange(7))} for n in range(90)}
    held |= {n: held[n % 3] - {f"own{n % 3}"} for n in range(90, 120)}
    rows = [(n, k) for n, ks in held.items() for k in ks] * 2 + [(None, "k1"), (5, None)]
    most = 40
    counts = Counter(k for ks in held.values() for k in ks)
    used = {k for k, c in counts.items() if 2 <= c <= most}
    pairs = [(a, b) for a, b in combinations(held, 2) if len(held[a] & held[b] & used) >= 3]
    want = components(held, pairs)
    edges = graphs.linked_by_keys(spark.createDataFrame(rows, "n long, k string"), "n", "k", 2, most, 3)
    got = components(held, [(r["a"], r["b"]) for r in edges.collect()])
    assert got == want and len(set(want.values())) > 5
    assert graphs.linked_by_keys(spark.createDataFrame([], "n long, k string"), "n", "k", 2, most, 3).count() == 0


def test_similar_sets_beside_themselves(spark):
    rng = random.Random(5)
    sets = {n: sorted(rng.sample(range(30), rng.randrange(1, 14))) for n in range(120)}
    df = spark.createDataFrame([(n, [str(x) for x in s]) for n, s in sets.items()], "key long, s array<string>")
    got = {(r["a"], r["b"]) for r in similar_sets(df, df, 0.55, once=True).collect()}
    want = {(a, b) for a, b in combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) >= 0.55 * len(set(sets[a]) | set(sets[b])) - 1e-12}
    assert got == want and want


def test_identity_match_loses_no_link_between_different_texts(spark, tmp_path):
    """Copies come once, beside the least of their text; different texts are all paired, with equal sets of words or not."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(12)]
    texts = {n: " ".join(rng.sample(words, rng.randrange(5, 10))) for n in range(30)}
    texts |= {n: " ".join(reversed(texts[n % 10].split())) + "!" for n in range(30, 50)}
    texts |= {n: texts[n % 15 + 20] for n in range(50, 90)} | {90: None, 91: "", 92: "a b c", 93: "a b c", 94: "WORD1 word2."}
    rows = rng.sample(list(texts.items()), len(texts))
    spark.createDataFrame([*rows, (None, texts[3]), (None, "lonely")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["a"], r["b"], r["jaccard"]) for r in graphs.identity_match(spark, str(tmp_path)).collect())
    sets = {n: {w for w in (t or "").lower().strip("!.").split() if len(w.strip("!")) >= 5} for n, t in texts.items()}
    lead = {}
    for n in sorted(texts):
        lead.setdefault(texts[n], n)
    want = [(lead[texts[n]], n, 1.0) for n in texts if sets[n] and lead[texts[n]] != n]
    for a, b in combinations(sorted(n for n in lead.values() if sets[n]), 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        want += [(a, b, round(alike, 6))] * (alike >= 0.55)
    assert got == sorted(want)
    assert sum(sets[a] == sets[b] and texts[a] != texts[b] for a, b, _ in got) > 10


def test_title_gate_takes_ascii_letters_alone_for_words(spark, tmp_path):
    """A letter of another script beside a junk word does not hide it, as in SQL."""
    titles = {1: "as, que queñiejaco", 2: "éque que leen", 3: "que quejas", 4: "a que que b", 5: "aque que", 6: "éé ñ", 7: "horoscope_x", 8: "Plain title"}
    spark.createDataFrame([(n, t + "\nrest", "src3") for n, t in titles.items()], "doc_id int, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in enrichment.title_junk_gate(spark, str(tmp_path)).collect()) == [3, 5, 7, 8]


def test_identity_pairs_are_all_pairs(spark, tmp_path, monkeypatch):
    """Copies and equal sets are paired with one another and with all that is alike, in whatever parts a common set is dealt out."""
    monkeypatch.setattr(graphs, "TOGETHER", 4)
    rng = random.Random(11)
    words = [f"word{i}" for i in range(12)]
    texts = {n: " ".join(rng.sample(words, rng.randrange(5, 10))) for n in range(20)}
    texts |= {n: texts[n % 4] for n in range(20, 45)} | {n: " ".join(reversed(texts[n % 4].split())) for n in range(45, 55)} | {90: None, 91: "", 92: "a b"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["a"], r["b"], r["jaccard"]) for r in graphs.identity_pairs(spark, str(tmp_path)).collect())
    sets = {n: set(t.split()) for n, t in texts.items() if t and n < 90}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    assert got == sorted((a, b, round(s, 6)) for (a, b), s in alike.items() if s >= 0.55)
    assert (24, 28, 1.0) in got
