"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import gzip
import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from presswave.llm import exact_dedup, html_extract, line_dedup, near_dedup, packing, permutation_index, quality, quotes, sentencepiece_codec, warc
from presswave.llm.lookup import Remembered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(400))


def documents(spark, texts, first=1):
    return spark.createDataFrame([(first + k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with names the operators use."""
    some = [None, "", LONG, LONG, LONG + " x", "a\nb\n", "a\nb\n", "éa ñ\n\n" + "z" * 30, "z" * 30, "Z" * 30 + "\t", "  " + "z" * 30]
    df = documents(spark, some).union(spark.createDataFrame([(None, "z" * 30, None, None, None), (3, LONG, "en", "s0", 1)], DOCS))
    return df.withColumn("tag", F.lit("mine")).withColumn("keep", F.lit(1)).withColumn("n", F.lit(2))


EMPTY = lambda spark: spark.createDataFrame([], DOCS)


def test_exact_dedup(spark):
    df = odd(spark)
    got = exact_dedup.exact_dedup(df).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    groups = Counter(t for _, t in texts)
    want = sorted((str(d), str(max((x for x, u in texts if u == t and x is not None), default=None)), groups[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in texts)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.exact_dedup(EMPTY(spark)).count() == 0


def test_chunks_are_the_text(spark):
    texts = [LONG * 9, "x" * 30000, "a.\n" * 2000, "", "é" * 5000 + "."]
    rows = documents(spark, texts).select("text", exact_dedup.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] for r in rows)


def brute_lines(rows, least=20, docs=3):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < docs or d == max((y for y in held[key(x)] if y is not None), default=None)]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    for df in (odd(spark), EMPTY(spark)):
        got = line_dedup.dedup_lines(df)
        assert set(df.columns) <= set(got.columns)
        assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    long = "\n".join(f"a line of some length {k % 9000}" for k in range(20_000))
    clash = documents(spark, [long, long + "\nx", "a line of some length 5", "b"]).withColumns({"keep": F.lit("mine"), "dropped": F.lit(3), "n_lines": F.lit(-1), "tag": F.lit("t"), "a.b": F.lit(9)})
    got = line_dedup.dedup_lines(clash)
    assert sorted(got.columns) == sorted([*clash.columns, "n_dropped"]) and {(r["keep"], r["dropped"], r["tag"], r["a.b"]) for r in got.collect()} == {("mine", 3, "t", 9)}
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines([(r["doc_id"], r["text"]) for r in clash.collect()])
    bitmaps = line_dedup.keep_bitmaps(odd(spark).select("doc_id", "text")).collect()
    assert all(sum(run["length"] for run in r["keep"]) == r["n_lines"] - r["n_dropped"] for r in bitmaps)


def near(spark, df, threshold=0.8):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    rows = df.collect()
    bags = [bag(re.findall(r"\w+", (r["text"] or "").lower())) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = (bags[i] & bags[j]).total()
        if both and both / (bags[i].total() + bags[j].total() - both) >= threshold:
            group = [group[i] if g == group[j] else g for g in group]
    return rows, group


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for k in (1, 2, 3, 40):
            c = list(b)
            for at in rng.choice(120, k, replace=False):
                c[at] = "changed"
            texts.append(" ".join(c).upper())
    df = documents(spark, [*texts, texts[0], None, "", "!!", "one two", "One, two"])
    rows, group = near(spark, df)
    least = {g: min(r["doc_id"] for r, h in zip(rows, group) if h == g) for g in group}
    want = {r["doc_id"]: least[g] for r, g in zip(rows, group)}
    got = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sum(r["kept"] for r in got) == len(set(want.values()))
    assert near_dedup.near_duplicates(EMPTY(spark)).count() == 0


def test_near_copies_below_the_threshold_stay_apart(spark):
    """A group whose members are near the threshold of each other, and two bridges in it."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(60):
        c = list(base)
        for at in rng.choice(100, 2 if k % 10 else 1, replace=False):
            c[at] = f"new{rng.integers(0, 40)}"
        texts.append(" ".join(c))
    df = documents(spark, texts)
    rows, group = near(spark, df)
    least = {g: min(r["doc_id"] for r, h in zip(rows, group) if h == g) for g in group}
    assert len(set(group)) > 10
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {r["doc_id"]: least[g] for r, g in zip(rows, group)}


def test_long_texts_just_below_the_threshold_are_told_by_parities(spark, monkeypatch):
    """Texts with one base that differ in many places: bags meet for few of their pairs, and no link is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(1500)]
    spots = rng.choice(1500, 40, replace=False)
    seen = []
    told = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, bags, threshold: (seen.append(pairs.distinct().count()), told(pairs, bags, threshold))[1])
    texts = []
    for k in range(60):
        c = list(base)
        for at in spots:
            c[at] = f"alt{at}_{rng.integers(0, 12)}"
        texts.append(" ".join(c))
    texts += [texts[0] + " and more", texts[1].replace("w7 ", "v7 ")]
    df = documents(spark, texts)
    rows, group = near(spark, df)
    least = {g: min(r["doc_id"] for r, h in zip(rows, group) if h == g) for g in group}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == {r["doc_id"]: least[g] for r, g in zip(rows, group)}
    assert seen[-1] < 100 < 60 * 59 / 2


def test_folded_parities_bound_the_difference(spark):
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 60, 500)
    sets = [one[:120], one[5:125], one[:130], one[:131], one[300:], one[:0], one[:64], one[1:65]]
    rows = [(k, near_dedup.wide_parities(x).tolist(), len(x)) for k, x in enumerate(sets)]
    bags = spark.createDataFrame(rows, "node long, wide array<long>, size long")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "u long, v long")
    got = {(r["u"], r["v"]) for r in near_dedup.not_apart(pairs, bags, 0.8).collect()}
    jaccard = lambda x, y: len({*x} & {*y}) / max(1, len({*x} | {*y}))
    want = {(a, b) for a in range(8) for b in range(a + 1, 8) if jaccard(sets[a].tolist(), sets[b].tolist()) >= 0.8}
    assert want <= got and (0, 4) not in got and (4, 5) not in got and len(rows[2][1]) < len(rows[3][1]) * 2


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"Wörd{k % 97}" for k in range(3000))
    whole = near_dedup.shingle_bags([text, "", "a b"])
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    monkeypatch.setattr(near_dedup, "PROCESSES", 7)
    parts = near_dedup.shingle_bags([text, "", "a b"])
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2] for a, b in zip(whole, parts, strict=True))
    small = near_dedup.bag_minhash(parts[:1], 64)
    monkeypatch.setattr(near_dedup, "PROCESSES", 1 << 17)
    assert (small == near_dedup.bag_minhash(whole[:1], 64)).all()


def test_keep_one_keeps_one_row(spark):
    kept = near_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    words = [tuple(re.findall(r"\w+", (r["text"] or "").lower())) for r in kept.collect()]
    assert sum(w[:5] == ("word0", "word1", "word2", "word3", "word4") for w in words) == 1


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(150):
        v = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
        a = rng.integers(0, 9, len(v))
        b = np.where(rng.random(len(v)) < 0.7, a, rng.integers(0, 9, len(v)))
        bags = [(v[x > 0], x[x > 0]) for x in (a, b)]
        s = near_dedup.bag_minhash(bags, 128)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.012


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [None, "", "It's  a\xa0test, we'll see 12 ½ <|endoftext|>", "ΣΑΣ naïve é", LONG * 4, "x y z"] + [f"text number {k} " * (k % 40) for k in range(120)]
    df = documents(spark, texts).withColumn("length", F.lit("clash"))
    got = packing.pack(df, path).toPandas()
    for (d, t) in [(k + 1, t or "") for k, t in enumerate(texts)]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == list(range(0, len(ids), 2048))
        assert [np.uint32(x) for x in own.ids_crc32] == [np.uint32(__import__("zlib").crc32(ids[s : s + 2048].tobytes())) for s in own.start]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(EMPTY(spark), path).count() == 0


def test_configurations_are_close_to_the_bound():
    rng = np.random.default_rng(1)
    histogram = dict(Counter(rng.integers(300, 1500, 5000).tolist()))
    plan = packing.rounded(histogram, packing.solve(histogram))
    used = Counter()
    for items, times in plan:
        assert sum(k * n for k, n in items.items()) <= 2048
        for k, n in items.items():
            used[k] += n * times
    assert used == Counter(histogram)
    rest, bins = sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True), []
    for k in rest:  # best fit decreasing
        fit = min((b for b in bins if b[0] >= k), default=None, key=lambda b: b[0])
        (fit.__setitem__(0, fit[0] - k) if fit else bins.append([2048 - k]))
    assert sum(t for _, t in plan) <= len(bins) * 1.01


@pytest.mark.parametrize(
    ("histogram", "best"),
    [
        ({1100: 1000, 500: 1000}, 1000),  # a long piece in each sequence, and 500s fit beside them
        ({1100: 1000, 900: 700, 500: 1000}, 1175),  # prices 3/4, 1/4, 1/4 prove it
        ({1025: 30, 1023: 30, 2048: 5}, 35),
        ({700: 900, 690: 500, 660: 800, 1000: 300}, 988),  # best fit needs 1034
        ({7: 1}, 1),
        ({}, 0),
    ],
)
def test_few_lengths_need_the_fewest_sequences(histogram, best):
    plan, bound = packing.program(histogram)
    used = Counter()
    for items, times in plan:
        assert sum(k * n for k, n in items.items()) <= 2048
        for k, n in items.items():
            used[k] += n * times
    assert used == Counter(histogram)
    assert bound <= best + 1e-6 and sum(t for _, t in plan) <= best


def test_best_fit_over_counts_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for top in (300, 1200, 2048):
        histogram = dict(Counter(rng.integers(1, top, 800).tolist() * 3))
        bins = []
        for k in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fit = min((b for b in bins if b[0] >= k), default=None, key=lambda b: b[0])
            (fit.__setitem__(0, fit[0] - k) if fit else bins.append([2048 - k]))
        plan, used = packing.best_fit(histogram), Counter()
        for items, times in plan:
            used.update({k: n * times for k, n in items.items()})
        assert used == Counter(histogram)
        assert sorted(2048 - sum(k * n for k, n in x.items()) for x, t in plan for _ in range(t)) == sorted(b[0] for b in bins)


def test_sentencepiece(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = sentencepiece_codec.codec(path)
    score = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            score[model.id_to_piece(k)] = model.get_score(k)

    def best(text):
        top = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            top[e] = max([top[e - 1] + one.unknown] + [top[b] + score[text[b:e]] for b in range(e) if text[b:e] in score])
        return top[-1]

    for text in ["Hello the world", "anly thence 12", "é 漢x", "Zürich ist gross.\nJa"]:
        ids = next(iter(one.encode([text]))).tolist()
        got = sum(score.get(model.id_to_piece(k), 0.0) for k in ids if k not in one.byte_of) + one.unknown * len(re.findall(r"(?:\x00)", "".join("\x00" if c not in score else "" for c in text.replace(" ", "▁") if any(model.is_byte(k) for k in model.encode(c)[-1:]))))
        assert one.decode(np.array(ids)) == text
        if not any(k in one.byte_of for k in ids):
            assert abs(got - best("▁" + text.replace(" ", "▁"))) < 1e-6
    texts = [None, "", " lead", "two  spaces ", "▁mark", "\ttab\n", LONG, "漢字 🙂"]
    rows = sentencepiece_codec.roundtrip(documents(spark, texts), path).collect()
    told = {r["doc_id"]: r["decoded_sha256"] for r in rows}
    assert [told[k + 1] for k in range(len(texts))] == [hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest() for t in texts]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please.</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold&nbsp;text</b> here,
with a line break.<p>Second paragraph &lt;tag&gt; of the article.<ul><li>item one<li>item two</ul><aside>Related story</aside><form>Name <input></form></article>
<section id="comments"><p>Reader says no.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst bold text here, with a line break.\nSecond paragraph <tag> of the article.\nitem one\nitem two"
    assert html_extract.extract(PAGE) == want
    bare = "<body><div class=menu><a href=1>one</a><a href=2>two</a></div><div><div><p>" + "A long sentence of text. " * 9 + "</p><p>" + "More of the same text. " * 8 + "</p></div></div></body>"
    assert html_extract.extract(bare).split("\n") == [("A long sentence of text. " * 9).strip(), ("More of the same text. " * 8).strip()]
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "u", ""), (None, "u", "plain & text"), (3, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
    assert got == {(1, "u"): (want, len(want)), (2, None): ("", 0), (2, "u"): ("", 0), (None, "u"): ("plain & text", 12), (3, "u"): ("deep", 4)}


def test_html_keeps_every_article_of_a_page():
    a, b, c = ("Some words of text for the first. " * 12).strip(), ("Other words, of the second one. " * 9).strip(), ("A quoted post that is denser. " * 30).strip()
    two = f"<article><p>{a}</p></article><article><p>{b}</p></article>"
    assert html_extract.extract(f"<body><main>{two}</main></body>").split("\n") == [a, b]
    many = f"<article><h2>Head</h2>{f'<p>{a}</p>' * 4}</article><article><p>{b}</p></article>"
    assert html_extract.extract(f"<body>{many}<div><a href=1>home</a></div></body>").split("\n") == ["Head", a, a, a, a, b]
    links = "".join(f"<div><a href={k}>link {k}</a></div>" for k in range(40))
    nested = f"<body>{links}<article><p>{a}</p><article>{f'<p>{c}</p>' * 4}</article><p>{b}</p></article></body>"
    assert html_extract.extract(nested).split("\n") == [a, c, c, c, c, b]


def planted(article: str, k: int) -> tuple[str, str]:
    """A page around planted blocks, its article element named ``article``, and the text it must give."""
    rng = np.random.default_rng(k)
    words = lambda n: " ".join(f"wörd{rng.integers(0, 500)}" for _ in range(n))
    blocks = [words(6)] + [words(int(n)) for n in rng.integers(3, 60, 1 + k % 9)]
    links = "".join(f"<li><a href=/{j}>{words(1)}</a></li>" for j in range(8))
    body = "".join(f"<p>{b.replace(' ', ' <b>&amp;</b> ', 1)}" + "</p>" * (j % 2) for j, b in enumerate(blocks[1:]))
    page = f"<html><body><nav><ul>{links}</ul></nav><div class=ad>{words(9)}</div><{article}><h1>{blocks[0]}</h1>{body}</{article}><div><a href=/x>{words(2)}</a></div><footer>{words(8)}</footer></body></html>"
    return page, "\n".join([blocks[0]] + [b.replace(" ", " & ", 1) for b in blocks[1:]])


@pytest.mark.parametrize("article", ["article", "main", "div", "section", 'div class="x"'])
def test_density_finds_planted_articles(article):
    for k in range(60):
        page, want = planted(article, k)
        page = page.replace(f"</{article}>", f"</{article.split()[0]}>")
        assert html_extract.extract(page) == want


def test_an_article_in_sections_is_whole():
    a, b, c = ("Several words of the first part, and more. " * 9).strip(), ("Another part with words. " * 5).strip(), ("A short third one. " * 4).strip()
    page = f"<body><div>Home page</div><div><section><h2>One</h2><p>{a}<p>{a}</section><section><p>{b}</section><section><p>{c}</section></div><div><a href=1>older</a> <a href=2>newer</a></div></body>"
    assert html_extract.extract(page).split("\n") == ["One", a, a, b, c]


@pytest.mark.parametrize("bit", ["<a ", "<b>", "</i>", "<p><b>", "<!x", '<a "', "<div>", "<li><b>", "<script", "<textarea>", "<"])
def test_parsing_is_linear(bit):
    import time

    began = time.process_time()
    html_extract.extract("<p>hello</p>" + bit * 20_000 + ">")
    html_extract.extract("<p>hello</p>" + bit * 20_000)
    assert time.process_time() - began < 5


def test_extract_pages_rows(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>" + "long text " * 200_000), (2, "u", "<p>a&nbsp;b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = sorted((str(r["page_id"]), str(r["url"]), r["n_chars"]) for r in html_extract.extract_pages(df).collect())
    assert got == [("1", "None", 0), ("1", "u", 0), ("2", "u", 3), ("None", "u", 1_999_999)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_furniture_is_told_by_whole_attributes():
    plain = [' href="/news/hidden-gems"', ' title="The hidden cost"', ' data-id="header"', ' href="/p?id=comments"', " data-x='class=\"menu\"'", " href=/a/hidden id=x", ' aria-label="role=search"', ' data-hidden', ""]
    assert not [x for x in plain if html_extract.furniture("p", x, False)[0]]
    gone = [" hidden", ' HIDDEN=""', " class=menu", ' data-a="b"class="x sidebar"', " title='a' id = 'comments'", ' aria-hidden="true"', ' style="display: none"', ' href="/x" role=search']
    assert all(html_extract.furniture("p", x, False)[0] for x in gone)
    assert html_extract.extract('<body><p>Read <a href="/news/hidden-gems">these gems</a> now.</p></body>') == "Read these gems now."


WRAPPERS = ["<form action=/x>", "<div class='content-with-sidebar'>", "<div class=has-sidebar>", "<div id='site-header'>", "<section class='restaurant-menu'>", "<div class=sidebar><form>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_do_not_take_articles_away(wrapper):
    for k in range(20):
        page, want = planted("div", k)
        if len(want) < 600:
            continue
        page = page.replace("<body>", f"<body>{wrapper}").replace("</body>", "</form></section></div></div></body>")
        assert html_extract.extract(page) == want


def test_names_of_topics_stay_and_names_of_furniture_go():
    a, b = ("Some words of text for the first. " * 12).strip(), "A shorter one, of this topic."
    for named in ("section class='side-effects'", "h2 id='social-policy'", "p class='share-price up'", "div class='article-header'", "div class=header", "section class='restaurant-menu'", "p class='header-bidding'"):
        page = f"<body><nav>Home</nav><article><{named}>{b}</{named.split()[0]}><p>{a}</p><p>{a}</p></article></body>"
        assert html_extract.extract(page).split("\n") == [b, a, a], named
    for named in ("div class='social-share'", "div id=comments", "section class='x comment-list'", "div class='cookie-notice-bar'", "div class='sidebar-left'", "div class='ad_slot'", "form", "div role=complementary"):
        page = f"<body><nav>Home</nav><article><p>{a}</p><p>{a}</p><{named}>{a} {b}</{named.split()[0]}></article></body>"
        assert html_extract.extract(page).split("\n") == [a, a], named
    comments = f"<body><article><p>{a}</p></article><div class=comments>{f'<p>{a} {b}</p>' * 15}</div></body>"
    assert html_extract.extract(comments) == a


def test_warc(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k % 3}</p>" * 50) for k in range(1, 40)] + [(50, None, None), (51, "u", ""), (2, "again", "other"), (None, "u", "nobody")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archive(df, f"{tmp_path}/a", roll_bytes=600)
    files = manifest.collect()
    assert len(files) > 3 and sum(r["records"] for r in files) == len(rows) and not os.path.exists(f"{tmp_path}/a/tmp")
    assert all(hashlib.sha256(open(r["final"], "rb").read()).hexdigest() == r["sha256"] for r in files)
    assert all(gzip.open(r["final"]).read().startswith(b"WARC/1.1\r\n") for r in files)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.read_archive(manifest).collect())
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = sorted((str(p), len((h or "").encode()), "response" if last[h or ""] in (p, -1) else "revisit", "None" if last[h or ""] in (p, -1) else str(last[h or ""])) for p, _, h in rows)
    assert got == want
    again = warc.write_archive(df, f"{tmp_path}/b", roll_bytes=600)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in files)
    with pytest.raises(FileExistsError):
        warc.write_archive(df, f"{tmp_path}/b")
    none = warc.write_archive(df.limit(0), f"{tmp_path}/none")
    assert none.count() == warc.read_archive(none).count() == 0


def test_warc_shards_are_deterministic_and_ordered(spark, tmp_path):
    rows = [(k * 7919 % 3000 if k % 3 else 1500, f"u{k}", f"payload {k % 500} " * 20) for k in range(3000)]
    df, told, before = spark.createDataFrame(rows, "page_id long, url string, html string"), [], spark.conf.get("spark.sql.shuffle.partitions")
    for k, parts in enumerate((4, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        files = warc.write_archive(df.repartition(parts), f"{tmp_path}/{k}", roll_bytes=20_000, shard_bytes=100_000).orderBy("shard", "seq").collect()
        told.append([(r["shard"], r["seq"], r["sha256"]) for r in files])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == told[1] and len({r[0] for r in told[0]}) >= 5
    ids = [int(x) for r in files for x in re.findall(rb"X-Page-Id: (\d+)", gzip.open(r["final"]).read())]
    assert len(ids) == 3000 and ids == sorted(ids)


def test_permutation_index(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[10] = x[60] = x[110]
    rows = [(k, x[k].tolist()) for k in range(400)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (None, x[0].tolist()), (950, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = permutation_index.search(df, F.col("vec_id") % 50 == 10).collect()
    hits = 0
    for q in range(10, 400, 50):
        s = (x.astype(float) * x[q].astype(float)).sum(1) / np.linalg.norm(x.astype(float), axis=1) / np.linalg.norm(x[q].astype(float))
        s[q] = -9
        top = np.lexsort((np.arange(400), -s))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(top.tolist()))
    assert hits >= 0.9 * 40
    few = permutation_index.search(df.filter("vec_id IN (50, 60, 70)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    odd_one = df.filter("vec_id < 60").union(spark.createDataFrame([(100 * k, [1.0, 2.0], 1) for k in range(30)], "vec_id long, embedding array<float>, v int"))
    assert {r["query_id"] for r in permutation_index.search(odd_one, F.col("vec_id") % 50 == 0).collect()} == {0, 50}
    twice = permutation_index.search(df.union(df.filter("vec_id = 50")), F.col("vec_id") == 50).collect()
    assert len(twice) == 5 and len({r["vec_id"] for r in twice}) == 5
    assert permutation_index.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_permutation_index_of_very_large_and_small_numbers(spark):
    """Vectors near the ends of the range of doubles have the neighbours and cosines of the same vectors at length one."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 8))
    sizes = 10.0 ** np.array([200, -200, 0, 307, -300, 160])[np.arange(90) % 6]
    df = spark.createDataFrame([(k, v) for k, v in enumerate((x * sizes[:, None]).tolist())], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = permutation_index.search(df, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == 45
    for q in range(0, 90, 10):
        s = unit @ unit[q]
        s[q] = -9
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == np.argsort(-s)[:5].tolist() and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)


def test_permutation_index_with_a_hot_cluster(spark):
    """A third of the vectors in one narrow cluster and a common vector, over several blocks."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 24))
    x[:3000] = x[0] + 0.05 * rng.normal(size=(3000, 24))
    x[3000:3600] = x[3000]
    x = rng.permutation(x).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, unit, hits = {}, x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for r in permutation_index.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    for q in range(0, 9000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += (np.array(got[q]) >= np.sort(s)[-5] - 1e-9).sum()
    assert len(got) == 180 and hits >= 0.9 * 900


def test_quotes(spark):
    rows = [
        (1, 0, "user", "The first point is about cats.\nAnd more."),
        (1, 1, "bot", "A second message.\n\nWith a paragraph\nof two lines."),
        (1, 2, "user", "Alice wrote:\n> the FIRST point  is about cats.\nI agree."),
        (1, 3, "bot", "> With a paragraph\n> of two lines.\n>> The first point is about cats.\nNested reply"),
        (1, 4, "user", "> never said this\nok"),
        (2, 5, "user", None),
        (None, 1, "user", "> lost"),
        (2, 5, "bot", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(0))
    got = {(r["conv_id"], r["turn"], r["role"]): (r["reply_to"], r["quoted"], r["linked"], r["text"]) for r in quotes.link_quotes(df).collect()}
    assert got[1, 2, "user"] == (0, 1, 1, "I agree.")
    assert got[1, 3, "bot"] == (1, 3, 3, "Nested reply")
    assert got[1, 4, "user"] == (3, 1, 0, "ok")
    assert got[2, 5, "user"] == (None, 0, 0, "") and got[None, 1, "user"][0] is None and len(got) == 8
    places = {(r["conv_id"], r["turn"]): r["place"] for r in quotes.link_quotes(df).collect()}
    assert [places[1, t] for t in range(5)] == [1, 2, 3, 4, 5] and places[None, 1] is None and places[2, 5] == 1
    assert quotes.link_quotes(df.limit(0)).count() == 0
    ordered = [(r["conv_id"], r["place"]) for r in quotes.conversations_in_order(df.filter("conv_id = 1")).collect()]
    assert ordered == sorted(ordered)


def test_places_in_blocks_of_turns(spark, monkeypatch):
    rng = np.random.default_rng(1)
    replies = [(c, t, None if t == 0 else int(rng.integers(-3, t)) if c else 0) for c in range(2) for t in range(0, 900, 3)]
    want = {}
    for c in range(2):
        ordered = sorted((r for r in replies if r[0] == c), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        want |= {(c, r[1]): k + 1 for k, r in enumerate(ordered)}
    monkeypatch.setattr(quotes, "BLOCK", 16)
    got = quotes.placed(spark.createDataFrame(replies, "conv_id long, turn long, reply_to long")).collect()
    assert {(r["conv_id"], r["turn"]): r["place"] for r in got} == want


def test_a_long_message_is_linear_in_its_lines(spark):
    text = "\n".join(f"{'> ' * (k % 3)}line {k % 50}" for k in range(20_000))
    df = spark.createDataFrame([(1, 0, "user", "line 7"), (1, 1, "bot", text)], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotes.link_quotes(df).collect()}
    assert got[1]["quoted"] == sum(k % 3 > 0 for k in range(20_000)) and got[1]["linked"] == sum(k % 3 > 0 and k % 50 == 7 for k in range(20_000))



def test_quality(spark):
    good = [f"A plain sentence number {k} with several ordinary words in it, and another one." for k in range(60)]
    bad = [f"spam{k} spam{k} spam{k} *** ### $$$ BUY!! NOW!! spam{k} spam{k} | | | |" for k in range(40)]
    df = documents(spark, good + bad).unionByName(spark.createDataFrame([(500, None, None, None, None), (None, good[0], None, "s0", 1)], DOCS))
    labels = spark.createDataFrame([(k + 1, int(k < 60), 0) for k in range(0, 100, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 102
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[k + 1] for k in range(60)) and not any(kept[k + 1] for k in range(60, 100))
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.keep_good(df, labels.limit(0)).count() == 102 and quality.keep_good(EMPTY(spark), labels).count() == 0


def test_posteriors_shrink(spark):
    rows = [(k, k, "big", "big/a", 2.0 if k % 10 else -2.0) for k in range(200)] + [(900, 900, "tiny", "tiny/a", -2.0), (901, 901, "tiny", "tiny/a", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, key long, host string, path string, evidence double").withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    got = {r["doc_id"]: r for r in quality.posteriors(df).collect()}
    assert all(0 < r["posterior"] < 1 for r in got.values())
    assert got[901]["posterior"] > 0.5 > got[900]["posterior"]


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, str(k), h := f"h{rng.integers(0, 5)}", f"{h}/{rng.integers(0, 3)}", float(rng.normal(int(h[1]) - 2, 2))) for k in range(300)]
    rows.append((None, "x", "", "", 0.3))
    df = spark.createDataFrame(rows, "doc_id long, key string, host string, path string, evidence double").withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    p = {r[1]: 1 / (1 + np.exp(-r[4])) for r in rows}
    group = lambda at: {g: np.array([p[r[1]] for r in rows if r[at] == g]) for g in {r[at] for r in rows}}
    hosts, paths, every = group(2), group(3), np.array(list(p.values()))
    noise = lambda groups: np.mean([x.var() / len(x) for x in groups.values()])
    spread = [max(np.var([x.mean() for x in hosts.values()]) - noise(hosts), 0), max(np.mean([(x.mean() - hosts[g.split("/")[0]].mean()) ** 2 for g, x in paths.items()]) - noise(paths), 0)]
    m = every.mean()
    k0, k1 = (min(1000, max(1, m * (1 - m) / v - 1)) if v else 1000 for v in spread)
    for r in quality.posteriors(df).collect():
        _, key, h, q, e = next(x for x in rows if x[1] == r["key"])
        host = (k0 * m + hosts[h].sum() - p[key]) / (k0 + len(hosts[h]) - 1)
        path = (k1 * host + paths[q].sum() - p[key]) / (k1 + len(paths[q]) - 1)
        path = min(max(path, 0.01), 0.99)
        assert abs(r["posterior"] - 1 / (1 + np.exp(-(e + np.log(path / (1 - path)))))) < 1e-9 and abs(r["host_mean"] - host) < 1e-9


def test_quality_carries_columns_and_long_texts(spark, monkeypatch):
    texts = ["A plain sentence with some words. " * 3, "*** ### buy buy buy buy ###", None, ""] * 6
    df = documents(spark, texts).withColumns({"key": F.lit("mine"), "kept": F.lit(7), "evidence": F.lit("e"), "host": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(k + 1, int(k % 4 == 0), 0) for k in range(12)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {(r["key"], r["kept"], r["evidence"]) for r in kept.collect()} == {("mine", 7, "e")}
    deep = quality.classify(df.limit(8), labels, path=F.concat_ws("/", "source", F.lit("news"), "lang"))
    assert deep.count() == 8
    text = "abc äöü ñ" * 400
    whole = quality.features([text, "x"])
    monkeypatch.setattr(quality, "BLOCK", 100)
    assert np.allclose(quality.features([text, "x"]), whole)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.classify(spark, docs, data)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and sum((d in ids) == bool(q) for d, q in labels.items()) >= 0.97 * len(labels)
    lines = corpus_pipeline.drop_lines(spark, kept, data)
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.collect()) == sorted((d, t) for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()]))
    one = corpus_pipeline.drop_near_copies(spark, lines, data)
    rows, group = near(spark, lines)
    wordless = sum(not re.search(r"\w", r["text"]) for r in rows)
    assert one.columns == docs.columns and one.count() == len(set(group)) and wordless >= 0
    packed = corpus_pipeline.pack(spark, one, data)
    assert packed.select("doc_id").distinct().count() == one.count()


def test_pipeline_rows(spark, tmp_path):
    """Nulls, repeats, an empty table and an extra column through all stages; n_chars follows the text."""
    import corpus_pipeline

    for name, df in (("odd", odd(spark).drop("tag", "keep", "n").withColumn("key", F.lit("mine"))), ("empty", EMPTY(spark))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        lines = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), f"{tmp_path}/{name}")
        assert lines.columns == df.columns and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd") and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in df.collect()}


def test_words_of_a_slice_are_looked_up_once():
    """Ids equal the tokenizer's for odd texts, also when words are forgotten; a word's repeats in a slice cost no lookup."""
    from tokenizers import Tokenizer

    class Counted(Remembered):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), packing.Words(path), random.Random(11)
    words.known, words.parts = Counted(words.encode_words, 40), Remembered(words.encode_parts, 30)
    characters = "abcdeéñßİıǅ'0129½²ª.,!|<>-\xa0\xad \t\n\r\x0b\x0c‐…‰⁞\x1c\x85ſÀ中\u0301"
    odd = ["", " ", "\xa0", "\n\n a\xa0b \x0c", "it's we'll 'SALE'", "a<|endoftext|>b", "<|x", "İstanbul ǅ e\u0301", "中 文", *("".join(rng.choices(characters, k=rng.randrange(40))) for _ in range(400)), "", "last"]
    for k in range(0, len(odd), 37):
        part = odd[k : k + 37]
        assert [x.tolist() for x in words.encode(part)] == [plain.encode(x, add_special_tokens=False).ids for x in part]
    assert list(words.encode([])) == [] and [x.tolist() for x in words.encode(["", " "])] == [[], []]
    words.known.asked = 0
    again = ["the same words\nagain " * 500] * 4
    assert [x.tolist() for x in words.encode(again)] == [plain.encode(x, add_special_tokens=False).ids for x in again]
    assert words.known.asked == 5  # four words, and the empty end of a text
