"""Prefix trie, language identification and fill-in-the-middle against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswave.llm import fill_middle, language_id, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


def brute_trie(rows):
    """The contract over Python dicts of whole prefixes."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: tuple(t for _, t in sorted(x, key=lambda r: r[0])) for c, x in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), ())[:h] + turns[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    inside = {k: [n for n in nodes if n[: len(k)] == k] for k in nodes}
    children = {k: sum(len(n) == len(k) + 1 for n in inside[k]) for k in nodes}
    saved = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == k)))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], sum(children[n] == 0 for n in inside[k]), sum(saved[n] for n in inside[k]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, more=()):
    df = spark.createDataFrame(rows, TURNS)
    for c in more:
        df = df.withColumn(c, F.lit("mine"))
    got = prefix_trie.prefix_trie(*prefix_trie.grafted(prefix_trie.ordered_turns(df)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_turns(seed):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "é b", "", "long " * 9])) for c in range(40) for t in range(draw.choice([1, 2, 5, 12]))]
    rows += [(100 + k, t, "user", f"same {t}") for k in range(30) for t in range(6)]  # copies
    rows += [(200, t, "user", str(t)) for t in range(150)]  # one long conversation, and its copy but for the end
    rows += [(205, t, "user", str(t) if t < 140 else "other") for t in range(150)]
    rows += [(41, None, None, None), (41, None, "user", "x"), (41, 0, "user", "x"), (41, 0, "user", "x"), (43, 1, "user", None), (None, 1, "user", "x"), (-7, 0, "user", "a"), (-5, 0, "user", "a")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [(4096, 8192), (3, 10**6)])
def test_trie_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot[0])
    monkeypatch.setattr(prefix_trie, "MOST_HOT", hot[1])
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    rows = random_turns(5)
    assert trie(spark, rows, ["depth", "size", "node", "bytes"]) == brute_trie(rows)


def test_trie_of_turnless_conversations(spark):
    # the base of 1 to 4 is absent, so their first h turns go: all that are left end at the root
    rows = [(c, 0, "user", "x") for c in range(1, 5)]
    assert trie(spark, rows) == brute_trie(rows)
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY_SHA256 for r in trie(spark, rows))
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


WORDS = {
    "en": "the and of that with have this from they would there their what about which when make like time just know people into year your good some could them".split(),
    "de": "der die und das nicht mit sich auf für ein eine auch nach wird bei einer über können haben schon müssen größe straße wäre durch zwischen immer".split(),
    "nl": "het een van dat niet zijn voor met ook maar naar wordt hebben deze door over kunnen moeten waren tussen altijd geen veel zoals worden mijn".split(),
    "fr": "les des une est dans pour que qui sur avec pas plus été cette mais aussi très être où même après depuis toujours français garçon leçon".split(),
    "es": "los las una está para que con por más pero también muy hasta desde siempre español niño mañana corazón están así donde según año".split(),
    "fi": "että olla mutta niin kuin hän joka tämä voida saada kaikki myös hyvä vielä äiti päivä työ mennä sitten jälkeen aina".split(),
}


def language_rows(n=60, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(n * len(WORDS)):
        lang = list(WORDS)[k % len(WORDS)]
        rows.append((k, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.choice([6, 20, 60]))).capitalize(), lang, "s"))
    return rows


def test_language_held_out(spark):
    rows = language_rows()
    odd = [(9001, None, "en", "s"), (9002, "", "en", "s"), (9003, "12 345 !? €", None, "s"), (None, "der die und das nicht", "de", "s"), (9004, rows[0][1], None, "s"), (9004, rows[0][1], None, "s"), (9005, " ".join(WORDS["fr"]) * 20000, None, None)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("draw", F.lit(2))
    got = language_id.language_id(df).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    truth = {d: lang for d, _, lang, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    named = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(9001, "und"), (9002, "und"), (9003, "und"), (None, "de"), (9004, "en"), (9005, "fr")} <= named
    # ids, sources and the languages of held-out rows play no part in a prediction
    other = df.withColumn("source", F.lit("other")).withColumn("lang", F.when(language_id.fold() == 0, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(str, language_id.language_id(other).collect())) == sorted(map(str, got))


def test_language_without_or_with_one_language(spark):
    none = spark.createDataFrame([(1, "word", None, "s"), (2, None, "en", "s")], DOCS)
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(none).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(k, "word", "en", "s") for k in range(8)], DOCS)
    assert {(r["lang_pred"], r["score"]) for r in language_id.language_id(one).collect()} == {("en", 1.0)}
    assert language_id.language_id(spark.createDataFrame([], DOCS)).count() == 0


def test_machine_parts_classes():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 8)).astype(np.float32)
    y = np.where(x[:, 0] + 2 * x[:, 3] > 0.1, 1.0, -1.0)
    w = language_id.machine(x, y, cost=10.0)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_long_texts_count_as_whole():
    text = " ".join(random.Random(2).choice(WORDS["de"]) for _ in range(250_000))
    counts, n = language_id._part_counts([text])
    long, m = language_id._long_counts(text)
    assert (counts[0] == long).all() and n[0] == m == sum(c.isalpha() for c in text)


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    x = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    some = [None, "", "\n", "\n\n\n", "one", "a\nb\nc\nd", "é\n😀x\nlast", "a <P> b\nc", "<S", "x<\nP>\n<S\n>", "\r\n a b\n"]
    texts = [t for t in some for _ in range(8)] + ["line %d\n" % k * 3 for k in range(40)] + ["word " * 300_000 + "\n" + "end"]
    rows = list(enumerate(texts)) + [(3, "again\nand again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N", F.lit("mine")).withColumn("a b`c", F.lit(1))
    made = fill_middle.fill_middle(df)
    assert made.columns == ["doc_id", "text", "a b`c", *fill_middle.ADDED]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"]["text"] == (r["text"] or "") and r["back"]["sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in got)
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in got)
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got if r["form"] != "plain") == sorted((d, *brute_fim(d, t)) for d, t in rows if brute_fim(d, t)[1] != "plain")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    null_id = fill_middle.fill_middle(spark.createDataFrame([(None, "a\nb")], "doc_id long, text string")).first()
    assert null_id["n"] == 2 and null_id["form"] == brute_fim("", "a\nb")[1]


def test_fill_middle_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_middle.fill_middle(df, rate=50, spm_rate=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260
