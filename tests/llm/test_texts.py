"""Tokens, BPE, languages, pages and licenses against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenhand.llm import bpe, html_text, language_id, licenses, token_counts
from evenhand.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n\t", "a", "é", "<s> </s> <unk>", "<|endoftext|>a<|endoftext|><|endoftext|> b", "x▁y ▁", "\x00\x1c\x85", "中文 文字", "😀👩‍🔬", "a" * 5000, "ab " * 4000, "1234567890" * 50, "<0x0A>\n"]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def odd_table(spark):
    rows = [(i, t, 7, "x", None) for i, t in enumerate(ODD)] + [(1, "", 7, "x", None), (None, "twice", 7, "x", None), (None, "twice", 7, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, lang_pred string")


# Token counts

MODEL = open(public_tokenizers.path(token_counts.MODEL), "rb").read()


def test_counts_of_the_query(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for r in QUERIES["op3_token_counts"](spark, SF_DIR).collect():
        n = len(library.encode(documents[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 2), (20, 4), (200, 16)])
def test_chunks_meet_at_stable_places(documents, chunk, overlap):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    counter = token_counts.Counter(MODEL, chunk, overlap)
    assert counter.plain
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "中", "文", "😀", "\x00", "▁", "1", "23", "<s>", "the", "<0x0A>", "‍"]
    made = ["".join(rng.choice(parts) * rng.choice([1, 1, 2, 17]) for _ in range(rng.randrange(1, 150))) for _ in range(150)]
    for text in [*made, *(t for t in ODD if t), *list(documents.values())[:20]]:
        assert counter.count(text) == len(library.encode(text)), text[:80]


def test_counts_of_odd_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = token_counts.count_tokens(odd_table(spark), chunk=64, overlap=8)
    assert got.columns == ["doc_id", "ids", "lang_pred", "n_tokens"]
    counts = Counter((r.doc_id, r.n_tokens) for r in got.collect())
    expected = Counter((i, len(library.encode(t or ""))) for i, t in enumerate(ODD))
    expected.update([(1, 0), (None, len(library.encode("twice"))), (None, len(library.encode("twice")))])
    assert counts == expected
    assert token_counts.count_tokens(odd_table(spark).limit(0)).count() == 0


# BPE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_of_the_query(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    for r in QUERIES["op7_byte_bpe"](spark, SF_DIR).collect():
        ids = library.encode(documents[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_ids_of_odd_texts(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    both = bpe.encode_decode(odd_table(spark))
    assert both.columns == ["doc_id", "n_tokens", "lang_pred", "ids", "decoded"]
    for r in both.where("doc_id is not null").collect():
        text = ODD[r.doc_id] or ""
        assert list(r.ids) == library.encode(text, add_special_tokens=False).ids
        assert r.decoded == text
    apart = bpe.decode(bpe.encode(odd_table(spark))).where("doc_id is not null")
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in apart.collect())
    assert both.count() == len(ODD) + 3
    assert bpe.encode_decode(odd_table(spark).limit(0)).count() == 0


def test_any_ids_decode_like_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    own = bpe.ByteBpe(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read())
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_bound_changes_nothing(documents, monkeypatch):
    content = open(public_tokenizers.path(bpe.VOCABULARY), "rb").read()
    texts = list(documents.values())[:15]
    free = [bpe.ByteBpe(content).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    monkeypatch.setattr(bpe, "STEP", 3)
    tight = bpe.ByteBpe(content)
    assert [tight.encode(t) for t in texts] == free
    assert len(tight) <= 10 and len(tight.older) <= 10


# Languages


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op5_kneser_ney"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "lang", "crc32(cast(doc_id as string)) % 4 = 2 as held_out").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == r.held_out and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held_out = [r for r in rows if r.held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held_out) >= 0.98 * len(held_out)


def naive_probability(counts, history, char, order):
    """Interpolated Kneser-Ney by its recursion, from the counts of one language's top events."""
    alphabet = len({c for g in counts for c in g}) + 1

    def values(size):
        out = {}
        for g, n in counts.items():
            if len(g) == size:
                out[g] = out.get(g, 0) + n
        if size < order:
            for longer in {g[-size - 1 :] for g in counts if len(g) > size}:
                out[longer[1:]] = out.get(longer[1:], 0) + 1
        return out

    def p(h, size):
        if size == 0:
            return 1 / alphabet
        if len(h) < size - 1:
            return p(h, size - 1)
        h_here = h[len(h) - size + 1 :]
        table = values(size)
        once, twice = list(table.values()).count(1), list(table.values()).count(2)
        d = once / (once + 2 * twice) if once else 0.5
        after = {g: n for g, n in table.items() if g[:-1] == h_here}
        total = sum(after.values())
        lower = p(h, size - 1)
        if not total:
            return lower
        return max(after.get(h_here + char, 0) - d, 0) / total * (h_here + char in after) + d * len(after) / total * lower

    return p(history, order)


def test_probabilities_follow_the_formula():
    words = Counter(["abab", "abba", "ba", "aab", "cab", "cab", "b"])
    grams = Counter()
    for word, n in words.items():
        marked = language_id.START + word + language_id.END
        for end in range(2, len(marked) + 1):
            grams[marked[max(0, end - language_id.ORDER) : end]] += n
    uniform = 1 / (len({c for g in grams for c in g}) + 1)
    model = language_id.Model(["xx"], uniform, [language_id.tables(list(grams), np.array(list(grams.values())), uniform)])
    for word in ("ab", "cabab", "zz", "a", "bacab"):
        marked = language_id.START + word + language_id.END
        expected = -sum(math.log(naive_probability(grams, marked[max(0, i - language_id.ORDER + 1) : i], marked[i], language_id.ORDER)) for i in range(1, len(marked)))
        got, n = model.surprise([word])
        assert n[0] == len(word) + 1
        assert got[0, 0] == pytest.approx(expected, rel=1e-5)


def test_languages_of_odd_texts(spark):
    sample = spark.createDataFrame([("aa", "hello there old friend " * 5, i % 2 == 0) for i in range(6)] + [("bb", "xyzzy plugh frotz gnusto " * 5, i % 2 == 0) for i in range(6)], "lang string, text string, calibrates boolean")
    model = language_id.fit(sample)
    rows = {r.doc_id: r for r in language_id.identify(odd_table(spark), model).where("doc_id is not null").collect()}
    for i, text in enumerate(ODD):
        blank = not any(c.isalpha() for c in text or "")
        assert (rows[i].lang_pred == "und") == blank
        assert rows[i].rejected or not blank
    good = language_id.identify(spark.createDataFrame([("old friend hello",), ("gnusto xyzzy",)], "text string"), model).collect()
    assert [(r.lang_pred, r.rejected) for r in good] == [("aa", False), ("bb", False)]
    assert language_id.fit(sample.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(odd_table(spark), None).collect()} == {"und"}
    assert language_id.identify(odd_table(spark).limit(0), model).count() == 0


def test_foreign_and_random_texts_are_rejected_with_a_large_alphabet(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    signs = [("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)),) for _ in range(60)]
    more = spark.createDataFrame(signs, "text string").selectExpr("-1 - monotonically_increasing_id() as doc_id", "'zh' as lang", "text")
    model = language_id.fit(language_id.training_sample(docs.unionByName(more), F.lit(True), 2000, "doc_id", "text", "lang"))
    assert 1 / model.uniform > 2500
    kept = language_id.identify(docs, model).where("not rejected")
    assert kept.count() >= 0.995 * docs.count()
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (3, 10, 100)]
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    parts = {r.lang: r.text for r in docs.where("length(text) > 2000 and lang in ('en', 'fr')").collect()}
    mixed = parts["en"][:1000] + " " + parts["fr"][:1000]
    got = language_id.identify(spark.createDataFrame([(t,) for t in [*letters, *foreign, mixed]], "text string"), model).collect()
    assert {r.text: r.rejected for r in got} == {**dict.fromkeys([*letters, *foreign], True), mixed: False}


def labelled(spark, texts):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string")


def fitted(docs, **bounds):
    return language_id.fit(language_id.training_sample(docs, F.lit(True), 2000, "doc_id", "text", "lang"), **bounds)


def test_small_languages_are_learned(spark):
    rng = random.Random(3)
    english = ["the", "house", "of", "some", "old", "friend", "and", "there", "were", "stones"]
    texts = [("en", " ".join(rng.choices(english, k=30))) for _ in range(200)]
    texts += [("ru", t) for t in ("дом старого друга", "камни и трава у дома", "старый друг идёт домой")]
    texts += [("x", "a b a b b")] + [("zz", "zork zyzzy zulu zap")] * 40
    docs = labelled(spark, texts)
    # Rows of one id and text share their hash: a language of such rows only is learned all the same.
    docs = docs.withColumn("doc_id", F.when(F.col("lang") == "zz", F.lit(1)).otherwise(F.col("doc_id")))
    model = fitted(docs)
    assert model.languages == ["en", "ru", "x", "zz"]
    asked = {"друг у старого дома": "ru", "b b a": "x", "zulu zork": "zz", "old stones and some house": "en"}
    got = language_id.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    assert {r.text: r.lang_pred for r in got} == asked


def test_any_number_of_languages_in_a_bounded_model(spark):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for k in range(60):
        words = ["".join(rng.choices(alphabet, k=rng.randint(3, 8))) for _ in range(40)]
        texts += [(f"l{k:02}", " ".join(rng.choices(words, k=60))) for _ in range(12)]
    docs = labelled(spark, texts)
    sample = language_id.training_sample(docs, F.lit(True), 2000, "doc_id", "text", "lang")
    whole, tight = language_id.fit(sample), language_id.fit(sample, all_grams=60 * 100)
    assert len(whole.languages) == len(tight.languages) == 60
    # 100 n-grams of full length, and what they end in.
    assert max(len(t[-1][0]) for t in tight.fitted) < 140 < max(len(t[-1][0]) for t in whole.fitted)
    for model, least in ((whole, 0.99), (tight, 0.9)):
        got = language_id.identify(docs, model)
        assert got.where("lang = lang_pred").count() >= least * len(texts)


def test_score_is_as_sure_as_the_answers_are_right(spark):
    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    # Two languages that differ in how often they use the same words.
    weights = {"p": [3] * 30 + [2] * 30, "q": [2] * 30 + [3] * 30}
    rows = [(lang, " ".join(rng.choices(common, w, k=40))) for _ in range(400) for lang, w in weights.items()]
    model = fitted(labelled(spark, rows))
    new = [(lang, " ".join(rng.choices(common, w, k=40))) for _ in range(200) for lang, w in weights.items()]
    got = language_id.identify(labelled(spark, new), model).collect()
    right, sure = sum(r.lang == r.lang_pred for r in got) / len(got), sum(r.score for r in got) / len(got)
    assert 0.6 < right < 0.97 and abs(right - sure) < 0.08


def test_known_text_is_hardly_ever_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = language_id.remainder(F.col("doc_id")) == 2
    model = language_id.fit(language_id.training_sample(docs, ~held_out, 2000, "doc_id", "text", "lang"))
    known = language_id.identify(docs.where(held_out & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")), model)
    assert known.where("rejected").count() <= 0.005 * known.count()


# Pages


def page(*body):
    return "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(body) + "</body></html>"


NAV = '<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>'
FOOT = "<footer>&copy; someone 2020, all rights reserved and so on</footer>"
LONG = "plenty of words in a row to read " * 8


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a  b\n c<p>d", "a b c\nd"),
        ("<script>var a = '<p>no</p>'", ""),
        (page(NAV, "<article><h1>Head &amp; &lt;tail&gt;</h1><p><b>one<br>two</p><p>three</article>", FOOT), "Head & <tail>\none two\nthree"),
        (page(NAV, f"<div id=content><h2>Head</h2><p>{LONG}</p><p>short</p></div>", '<div class="comments"><p>first! ' + LONG + "</p></div>", FOOT), f"Head\n{LONG.strip()}\nshort"),
        (page('<div class="cookie-notice">We use cookies</div>', "<main><p>x</p></main>", '<aside><p>side</p></aside><form><p>name</p><input></form>'), "x"),
        (page("<article><p>a</p>", '<div class="ad"><p>buy</p></div>', "<p hidden>no</p><p style='display:none'>no</p><p>b</p></article>"), "a\nb"),
        (page("<article><p>one <span>two</span>three</p><ul><li>x<li>y</ul><!-- <p>no</p> --></article>"), "one twothree\nx\ny"),
        (page("<article>a<p>b</p>c<hr>d</article>"), "a\nb\nc\nd"),
        ("<article><p>cut off <a href='x", "cut off <a href='x"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><meta charset=x><body><p>a</p></body>", "a"),
        ("<html><head><title>t</title><p>a</p>", "a"),
        ("<head><link rel=x>a", "a"),
        ("<head><noscript><img></noscript><style>x</style></head><body>a", "a"),
        (page('<article><p class="ad">buy<p>a</article>'), "a"),
        (page('<article><p class="ad"><span>buy<div>a</div></article>'), "a"),
        (page('<article><ul><li>w<li class="ad">x<li>y</ul><p>a</article>'), "w\ny\na"),
        (page('<article><ul><li class="ad">x</ul><p>a</article>'), "a"),
        (page('<article><dl><dt class="ad">x<dd>y</dl><p>a</article>'), "y\na"),
        (page('<article><div><p class="ad">buy</div><p>a</article>'), "a"),
        (page('<article><datalist><option>A<option>B</datalist><p>a</article>'), "a"),
        (page("<article><select><optgroup><option>A<optgroup><option>B</select><p>a</article>"), "a"),
        (page('<article><table><thead class="ad"><tr><th>x<tbody><tr class="ad"><td>y<tr><td>z<td class="ad">w</table><p>a</article>'), "z\na"),
        (page('<article>a <span class="ad">b <span>c</span><i>d</i></span>e<svg/>f</article>'), "a e\nf"),
        (page('<article><nav><ul><li>x<li>y</nav><p>a</article>'), "a"),
        (page("<article><ul><li>x<nav><li>y</nav>z</ul></article>"), "x\nz"),
    ],
)
def test_dropped_parts_end_without_their_end_tag(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f'<article><div class="article-header"><h1>Head</h1></div><p>{LONG}</p></article>'), f"Head\n{LONG.strip()}"),
        (page(f'<article><p>{LONG}</p><section id="discussion"><h2>D</h2><p>{LONG}</p></section></article>'), f"{LONG.strip()}\nD\n{LONG.strip()}"),
        (page(f'<main><p>{LONG}</p><h2 id="related-work">R</h2><p>b</p></main>'), f"{LONG.strip()}\nR\nb"),
        (page(f'<div id=content><p>{LONG}</p><p class="alert">Do not!</p><p>{LONG}</p></div>', FOOT), f"{LONG.strip()}\nDo not!\n{LONG.strip()}"),
        (page(f'<div class="post widget"><p>{LONG}</p><p>{LONG}</p></div>', "<p>short</p>"), f"{LONG.strip()}\n{LONG.strip()}"),
        (page(f'<article><p>{LONG}</p><div class="related"><a href="/">See also</a></div><p>b</p></article>'), f"{LONG.strip()}\nb"),
        (page(f'<article><p>{LONG}</p><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></article>'), f"{LONG.strip()}\n{LONG.strip()}"),
        (page(f'<main><article><p>{LONG}</p></article><div id="comments"><p>{LONG}{LONG}</p></div></main>'), LONG.strip()),
        (page('<article><p>one <span class="search">two <span>three</span></span> four <a class="share" href="/">five</a> six <span class="ad">x</span></p></article>'), "one two three four six"),
        (page(f'<div class="alert"><p>Out of service</p></div><article><p>{LONG}</p></article>'), LONG.strip()),
    ],
)
def test_words_of_class_and_id_are_evidence(html, text):
    assert html_text.main_text(html) == text


def test_text_beside_the_article_element():
    long = LONG * 4
    one, two, lead = ("".join(f"<p>{w} {long}</p>" for w in ws) for ws in (("a", "b", "c"), ("d", "e"), ("f",)))
    words = lambda *ws: "\n".join(f"{w} {long.strip()}" for w in ws)
    assert html_text.main_text(page(NAV, f"<article>{one}</article><article><h2>h</h2>{two}</article>", FOOT)) == words("a", "b", "c") + "\nh\n" + words("d", "e")
    assert html_text.main_text(page(NAV, f"{lead}<article><h2>h</h2>{one}</article>", FOOT)) == words("f") + "\nh\n" + words("a", "b", "c")


def test_deep_pages_do_not_overflow():
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"


def test_pages_of_the_query(spark):
    rows = {r.page_id: r for r in QUERIES["op2_text_density"](spark, SF_DIR).collect()}
    import html
    import re

    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert rows[r.page_id].text == "\n".join(b for b in blocks if b)
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url


def test_pages_keep_their_columns(spark):
    df = spark.createDataFrame([(1, None, "old", None), (1, "<p>x", "old", "u"), (None, "", None, None)], "page_id long, html string, text string, url string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.text, r.url) for r in got.where("url is not null").collect()) == [("x", "u")]
    assert got.count() == 3 and html_text.extract(df.limit(0)).count() == 0


# Licenses


def naive_license(text, templates, frequencies, n, threshold):
    unseen = math.log(n + 1.0) + 1
    vocabulary = {t for notices in templates.values() for x in notices for t in licenses.terms(x)}

    def vector(x):
        return {t: c * ((math.log((n + 1.0) / (frequencies.get(t, 0) + 1.0)) + 1) if t in vocabulary else unseen) for t, c in Counter(licenses.terms(x)).items()}

    def cosine(a, b):
        length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return round(sum(v * b.get(t, 0.0) for t, v in a.items()) / length, 9) if length else 0.0

    found = [(-cosine(vector(unit), vector(x)), name) for unit in [*(text or "").split("\n"), text or ""] for name, notices in templates.items() for x in notices]
    best = min(found)
    return best[1] if -best[0] >= threshold else None


def test_own_licenses_against_plain_cosines(spark, documents):
    rows = QUERIES["op10_license_scan"](spark, SF_DIR).collect()
    n = len(documents)
    frequencies = Counter(t for text in documents.values() for t in set(licenses.terms(text)))
    assert len(rows) == n
    for r in rows:
        assert r.own_license == naive_license(documents[r.doc_id], licenses.TEMPLATES, frequencies, n, licenses.THRESHOLD)


def test_standard_headers_and_texts(spark, documents):
    import textwrap

    longer = licenses.standard_texts()
    prose = [t for t in documents.values() if t and len(t) > 500][:20]

    def header(text, mark="# "):
        return "import os\n\n" + textwrap.indent(textwrap.fill(text, 76), mark, lambda _: True) + "\n\n" + prose[0]

    expected = {header(text): name for name, texts in longer.items() for text in texts if len(text) < 2500}
    expected |= {"Copyright (c) 2020 Some One\n\n" + text: name for name, texts in longer.items() for text in texts if len(text) >= 900}
    gpl = longer["GPL-3.0"][0].split(". This")
    expected["/*\n * frob.c - frobs\n *\n * " + ".\n *\n * This".join(gpl) + "\n */\nint main() { return 0; }"] = "GPL-3.0"
    expected["This file is released under the MIT license; see the LICENSE file"] = "MIT"
    rows = [*expected, *prose]
    got = licenses.own_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")).collect()
    wrong = {rows[r.i][:60]: (r.own_license, r.cosine) for r in got if r.i < len(expected) and r.own_license != expected[rows[r.i]]}
    assert not wrong


def test_frequent_other_words_weigh_less(spark):
    texts = ["qua released under the wug license qua"] + ["qua"] * 500
    notices = {"Wug": ("Released under the Wug License.",)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    cosines = [r.cosine for r in licenses.own_licenses(df, notices).collect()]
    assert max(cosines) > 0.98


def test_all_words_weigh_by_their_frequency(spark, monkeypatch):
    notices = {"Wug": ("Released under the Wug License.",), "Zorp": ("You may use the zorp freely.",)}
    # More other words than all tasks know are in more files than "qua" and "pim", which stand around the notices.
    common = " ".join(f"w{i}" for i in range(licenses.FREQUENT + 500))
    texts = [common] * 12 + ["qua pim"] * 9 + ["qua released under the wug license pim", "only here\nqua released under the wug license once\nw1 w2", "use the zorp qua", "use the pim", "", None]
    texts += ["qua released under the wug license pim", common + "\nyou may use the zorp freely qua"]
    n = len(texts)
    frequencies = Counter(t for text in texts for t in set(licenses.terms(text or "")))

    def vector(text):
        return {t: c * (math.log((n + 1.0) / (frequencies[t] + 1.0)) + 1) for t, c in Counter(licenses.terms(text)).items()}

    def nearest(text):
        found = [(0.0, None)]
        for part in [*text.split("\n"), text]:
            for name, (notice,) in notices.items():
                a, b = vector(part), vector(notice)
                length = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                found.append((sum(v * b.get(t, 0.0) for t, v in a.items()) / length if length else 0.0, name))
        cosine, name = max(found, key=lambda f: f[0])
        return (name, round(cosine, 9)) if cosine >= licenses.THRESHOLD else (None, 0.0)

    expected = Counter((i, *nearest(text or "")) for i, text in enumerate(texts))
    assert sum(1 for _, name, _ in expected if name) >= 4
    df = spark.createDataFrame([*enumerate(texts)], "i int, text string").repartition(3)
    for known in (licenses.FREQUENT, 3, 0, 10**6):
        monkeypatch.setattr(licenses, "FREQUENT", known)
        got = licenses.own_licenses(df, notices)
        assert got.columns == ["i", "own_license", "cosine"]
        assert Counter((r.i, r.own_license, round(r.cosine, 9)) for r in got.collect()) == expected
    # Rows that share all their values stay apart.
    twice = licenses.own_licenses(df.unionByName(df).select("text"), notices).collect()
    assert Counter(r.own_license for r in twice) == Counter(name for _, name, _ in [*expected, *expected])


def test_nearest_directory_wins(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a.py", "code"), ("src/LICENSE.txt", gpl), ("src/x/y/b.py", "code"), ("src/c.py", "# " + mit), ("doc/COPYING", "nothing"), ("doc/d.md", None),
        ("/root.py", ""), (None, gpl), (None, None), ("a.py", "code"), ("src/x/LICENSE", ""), ("srcs/e", "code"),
    ]
    df = spark.createDataFrame([(p, t, "old", 1.0) for p, t in rows], "path string, text string, license string, cosine double")
    got = licenses.inherit(licenses.own_licenses(df))
    assert got.columns == ["path", "own_license", "cosine", "license", "license_dir"]
    out = Counter((r.path, r.license, r.license_dir) for r in got.collect())
    expected = [
        ("LICENSE", "MIT", None), ("a.py", "MIT", ""), ("a.py", "MIT", ""), ("src/LICENSE.txt", "GPL-3.0", None), ("src/x/y/b.py", "GPL-3.0", "src"), ("src/c.py", "MIT", None),
        ("doc/COPYING", "MIT", ""), ("doc/d.md", "MIT", ""), ("/root.py", "MIT", ""), (None, "GPL-3.0", None), (None, None, None), ("src/x/LICENSE", "GPL-3.0", "src"), ("srcs/e", "MIT", ""),
    ]
    assert out == Counter(expected)
    assert licenses.inherit(licenses.own_licenses(df.limit(0))).count() == 0
