"""Every operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import html as html_lib
import random
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from arbora.llm import common, decontaminate, html_extract, license_scan, quality_classifier, sentencepiece_codec, suffix_dedup, warc_store
from arbora.llm.jaccard_join import Spec, jaccard_classes
from arbora.llm.line_dedup import dedup_documents, line_dedup
from arbora.llm.quality_rules import kept_documents, quality_rules

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, words string, kept string, n_words string, component_id string, _hash2 int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", None, "z", 1) for i, t in rows], DOCS)


EDGE = [(None, None), (None, "the same words " * 40), (1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (4, "one"), (5, "the of aéb " * 3000), (6, "a b c d e f g h i j")]
OPERATORS = {
    "rules": quality_rules,
    "codec": sentencepiece_codec.encode_documents,
    "suffix": suffix_dedup.suffix_dedup,
    "lines": line_dedup,
    "jaccard": jaccard_classes,
    "licenses": license_scan.license_scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, name):
    got = OPERATORS[name](frame(spark, EDGE))
    ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x))
    assert ids == sorted((i for i, _ in EDGE), key=lambda x: (x is None, x))
    assert OPERATORS[name](frame(spark, EDGE).limit(0)).count() == 0


def test_very_long_texts(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(40_000)}" for _ in range(250_000)]
    item, notice = words[200_000:200_040], next(t.text for t in license_scan.TEMPLATES if t.name == "mit_grant")
    text = " ".join(words[:100_000]) + "\n" + " ".join(words[100_000:]) + " " + notice
    docs = frame(spark, [(1, text), (2, text[1:]), (3, "short")])
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.first_word, x.edits) for x in found) == [(1, 200_000, 0), (2, 200_000, 0)]
    assert {x.doc_id: x.labels for x in license_scan.license_scan(docs).collect()} == {1: "mit", 2: "mit", 3: ""}
    assert {x.doc_id: x.component_id for x in jaccard_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.doc_id: x.n_removed for x in suffix_dedup.suffix_dedup(docs).collect()} == {1: len(text) - 1, 2: len(text) - 1, 3: 0}
    assert all(x.decoded == {1: text, 2: text[1:], 3: "short"}[x.doc_id] for x in sentencepiece_codec.encode_documents(docs).collect())
    assert {x.doc_id: x.n_words for x in quality_rules(docs).collect()} == {1: len(text.split()), 2: len(text.split()), 3: 1}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {x.page_id: x.n_chars for x in html_extract.extract_pages(pages).collect()}[1] == len(text)
    assert {x.page_id: x.payload_bytes for x in warc_store.warc_round_trip(pages).collect()} == {1: len(text), 2: len(text) - 1, 3: 5}


def test_native_plans_have_no_python_and_the_rules_one_projection(spark):
    plan = quality_rules(frame(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Arrow" not in plan and "Python" not in plan


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get(common.CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    assert common.shared_dir(spark) == named.rstrip("/")
    df, path = common.materialize(spark.range(3), "t")
    assert df.count() == 3 and path.startswith(common.shared_dir(spark))
    common.remove(spark, path)


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    low = {x: x for p in pairs for x in p}
    for _ in range(len(low)):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == low
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 ------------------------------------------------------------------------------------------------------------------


def test_chain_labels_unseen_layouts():
    chain, right, n = html_extract.trained(), 0, 0
    for blocks, labels in html_extract.labelled(150, 991):
        scores = [sum(chain.weights.get(f, 0) for f in fs) for fs in html_extract.block_features(blocks)]
        right += sum(a == b for a, b in zip(chain.viterbi(scores), labels))
        n += len(labels)
    assert right / n > 0.985


def test_viterbi_is_the_best_labelling():
    r = random.Random(1)
    for _ in range(50):
        chain = html_extract.Chain({}, [[r.gauss(0, 2) for _ in range(2)] for _ in range(3)])
        scores = [r.gauss(0, 2) for _ in range(r.randint(1, 8))]

        def value(y, chain=chain, scores=scores):
            return chain.moves[2][y[0]] + sum(s * v for s, v in zip(scores, y)) + sum(chain.moves[a][b] for a, b in zip(y, y[1:]))

        best = max(value([k >> i & 1 for i in range(len(scores))]) for k in range(1 << len(scores)))
        assert value(chain.viterbi(scores)) == pytest.approx(best)


def test_names_behind_many_utility_classes_are_seen():
    utility = " ".join(f"mt{c} px{c}" for c in "abcdefgh")
    (block,) = html_extract.blocks_of(f'<div class="{utility} {utility} sidebar"><p>Some text here.</p></div>')
    assert {"w:sidebar", "w:px", "w:mta"} & set(html_extract.path_features(block.node)) >= {"w:sidebar", "w:mta"}


def test_slopes_of_the_likelihood():
    r = np.random.default_rng(4)
    feats, labels = [np.array(sorted(set(r.integers(0, 9, 4).tolist()))) for _ in range(6)], r.integers(0, 2, 6).tolist()
    w, moves = r.normal(size=9), r.normal(size=(3, 2))
    value, by_block, slope = html_extract.likelihood(feats, labels, w, moves)

    def plain(w, moves):
        def score(y):
            return moves[2, y[0]] + sum(w[f].sum() for f, v in zip(feats, y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:]))

        return score(labels) - np.log(sum(np.exp(score([k >> i & 1 for i in range(6)])) for k in range(64)))

    assert value == pytest.approx(plain(w, moves))
    for x in range(9):
        step = np.eye(9)[x] * 1e-5
        rise = (plain(w + step, moves) - plain(w - step, moves)) / 2e-5
        assert sum(b for f, b in zip(feats, by_block) if x in f) == pytest.approx(rise, abs=1e-6)
    for x in range(6):
        step = (np.eye(6)[x] * 1e-5).reshape(3, 2)
        assert slope.ravel()[x] == pytest.approx((plain(w, moves + step) - plain(w, moves - step)) / 2e-5, abs=1e-6)


#: Pages in layouts of other makers, with their main text; ``|`` parts its blocks.
LAYOUTS = [
    ("plain text no tags", "plain text no tags"),
    ("<p>just text</p>", "just text"),
    ("<p>Text one is here.</p><button-bar>b</button-bar><p>Text two is here.</p>", "Text one is here.|b|Text two is here."),
    (
        "<html><body><div id='page'><div id='masthead'><h1><a href=/>My Blog</a></h1></div><div id=content><div class='post-42 post type-post hentry'>"
        "<h2 class=entry-title>A walk in the hills</h2><div class=entry-content><p>We left early, before the sun was up.</p><p>It rained all day long, and we came home wet.</p>"
        "</div></div><div id=comments><ol class=commentlist><li class=comment><p>Lovely pictures, thanks for sharing them!</p></ol></div></div>"
        "<div id=sidebar class=widget-area><ul><li><a href=a>Archives</a><li><a href=b>Categories</a></ul></div><div id=footer>Proudly powered by a press. &copy; 2019</div></div>",
        "A walk in the hills|We left early, before the sun was up.|It rained all day long, and we came home wet.",
    ),
    (
        "<body><header class='site-header'><nav><a href=/>Home</a> <a href=/n>News</a></nav></header><main role=main><article><h1>Council votes on bridge</h1>"
        "<aside class='related-links'><ul><li><a href=1>Bridge closed again</a></li></ul></aside><p>The council voted on Monday to rebuild the old bridge.</p>"
        "<div class='ad-slot advert'><p>Buy one, get one free!</p></div><blockquote>It was high time, said the mayor.</blockquote><p>Work begins in spring, and will last two years.</p></article></main>"
        "<section class='newsletter signup'><form><p>Get our news by mail.</p><input><button>Go</button></form></section><footer class=site-footer><p>Terms</p></footer>",
        "Council votes on bridge|The council voted on Monday to rebuild the old bridge.|It was high time, said the mayor.|Work begins in spring, and will last two years.",
    ),
    (
        "<html><div class='cookie-banner' role=dialog>We use cookies to improve the site.<button>OK</button></div><div class=wrapper><div class='breadcrumbs'><a href=/>Docs</a> / <a href=/x>Setup</a></div>"
        "<div class='main content'><h1>Setting up</h1><p>Unpack the archive and run the script in it.</p><pre>make all</pre><ul><li>It needs a compiler.</li><li>It needs some time.</li></ul>"
        "<div style='display: none'>Old notes that nobody sees.</div></div></div>",
        "Setting up|Unpack the archive and run the script in it.|make all|It needs a compiler.|It needs some time.",
    ),
    (
        "<BODY><DIV CLASS=navigation><A HREF=1>One</A> <A HREF=2>Two</A></DIV><DIV CLASS='story'><H1>Fish &amp; chips</H1><P>Peel the potatoes first<BR>and cut them.<P>Fry them twice, as it is done by the sea.</DIV>"
        "<DIV CLASS=footer>Copyright 1999</DIV></BODY>",
        "Fish & chips|Peel the potatoes first and cut them.|Fry them twice, as it is done by the sea.",
    ),
]


@pytest.mark.parametrize("page, blocks", LAYOUTS)
def test_layouts_of_other_makers(page, blocks):
    assert html_extract.extractor(html_extract.trained())(page) == blocks.replace("|", " ")


@pytest.mark.parametrize(
    "page", ['<a href="x>y ' * 80_000, "<p title='x>abc " * 70_000, "<div>x" * 170_000, "<div>" * 40_000 + "</section>x" * 40_000, "<" * 1_000_000, '<p a="' * 170_000, "<ul><li>a" * 110_000, "<object>" * 120_000],
)
def test_odd_megabytes_take_seconds(page):
    began = time.time()
    html_extract.extractor(html_extract.trained())(page)
    assert time.time() - began < 5


def test_extraction(spark):
    article = "<h1>Title &amp; more</h1><p>First   para\n with <b>bo</b>ld &lt;x&gt;.</p><p>Second one, rather long, it is.<br>End.</p>"
    clutter = "<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
    after = "<section class=comments><p>Nice post, thank you!</p></section><footer>&copy; 2024 Us</footer>"
    page = f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{clutter}<article>{article}<div class=ad>Buy now.</div></article>{after}"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<!-- open"), (4, "u", "<!-- open")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")))
    got = sorted(got.collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert got[0].text == "Title & more First para with bold <x>. Second one, rather long, it is. End."
    assert got[0].n_chars == len(got[0].text)
    assert all(r.text == "" and r.n_chars == 0 for r in got[1:])
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_on_the_sample(spark):
    for r in html_extract.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert r.text == " ".join(html_lib.unescape(plain).split())


# 2 ------------------------------------------------------------------------------------------------------------------


def test_rules_against_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(t for _, t in EDGE)]
    rows += [(100, "x y z v w " * 4), (101, "- a\n- b\n- a\n" * 5), (102, "no stop words here at all okay " + "zzz " * 30), (103, "a b c d e f g h i j k " + "UP!! " * 20)]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        m = brute.measures(t)
        assert {k: got[i][k] for k in m} == m and got[i].kept == brute.kept(t)
    kept = kept_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if brute.kept(t)]


# 3 ------------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("bdklmnst") + r.choice("aeiou") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 45)))) for i in range(25)] + [(90, "too short"), (91, None)]
    rows, want = [], set()
    for i in range(120):
        host = [word() for _ in range(80)]
        if i % 3:
            k = r.randrange(25)
            part = items[k][1].split()
            for _ in range(r.randint(0, len(part) // 3)):
                o = r.randrange(len(part))
                part[o : o + r.randint(0, 1)] = [word()] * r.randint(0, 1)
            host[40:40] = part
            if i % 4 == 0:
                host = [w.upper() + "," for w in host]
        rows.append((i, " ".join(host)))
    for i, t in rows:
        want |= {(i, k) for k, x in items[:25] if brute.best_edits(brute.words(x), brute.words(t)) <= len(x.split()) // 5}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame(spark, rows + [(None, None), (500, "")]), bench).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 30
    left = decontaminate.without_leaks(frame(spark, rows + [(None, None)]), bench)
    assert {x.doc_id for x in left.collect()} == {i for i, _ in rows} - {i for i, _ in got} | {None}
    assert decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, f"{text} item {i}") for i in range(8)], "item_id long, text string")
    docs = frame(spark, [(i, f"before {text} item {i} after") for i in range(8)])
    whole = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    assert whole == sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect())


@pytest.mark.parametrize("n", [60, 400, 800])
def test_long_items_at_the_exact_bound(n):
    for seed in range(8):
        r = random.Random(seed)
        item = [f"w{r.randrange(3000)}" for _ in range(n)]
        gone = set(r.sample(range(n), n // 5))
        part = [w for i, w in enumerate(item) if i not in gone]
        host = [f"h{r.randrange(3000)}" for _ in range(60)]
        index = decontaminate.Index([(7, " ".join(item))], decontaminate.Spec())
        ids = np.array([index.numbers.get(w.encode(), 0) for w in host[:30] + part + host[30:]], dtype=np.int64)
        found = index.search([ids])
        assert len(found) == 1
        (found,) = found
        assert found[:3] == (0, 0, brute.best_edits(item, host[:30] + part + host[30:])) and found[2] <= n // 5


def _planted(r, n, vocabulary, edits):
    """An item, and a text that holds it with so many random edits at a random place."""
    item = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    part = list(item)
    for _ in range(edits):
        o, kind = r.randrange(len(part)), r.randrange(3)
        part[o : o + (kind != 1)] = [f"w{r.randrange(vocabulary)}"] if kind else []
    host = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 300))]
    o = r.randint(0, len(host))
    return item, host[:o] + part + host[o:]


@pytest.mark.parametrize("n", [7, 20, 48, 60, 200, 800])
def test_recall_at_the_edit_bound(n):
    """All edits allowed, in words that other items have too."""
    r, spec = random.Random(n), decontaminate.Spec()
    cases = [_planted(r, n, 3000, n // 5) for _ in range(60)]
    index = decontaminate.Index([(i, " ".join(item)) for i, (item, _) in enumerate(cases)], spec)
    got = {(t, k): edits for t, k, edits, _, _ in index.search([np.array([index.numbers.get(w.encode(), 0) for w in text]) for _, text in cases])}
    assert sum((i, i) in got for i in range(60)) >= 57
    for t, k in got if n < 100 else []:
        assert got[t, k] <= n // 5 and got[t, k] == brute.best_edits(cases[k][0], cases[t][1])


def test_matches_without_edits_are_always_found():
    for n in (1, 2, 5, 16, 31, 59, 130):
        r = random.Random(n)
        cases = [_planted(r, n, 400, 0) for _ in range(80)]
        index = decontaminate.Index([(i, " ".join(item)) for i, (item, _) in enumerate(cases)], decontaminate.Spec())
        got = {(t, k): e for t, k, e, _, _ in index.search([np.array([index.numbers.get(w.encode(), 0) for w in text]) for _, text in cases])}
        assert all(got[i, i] == 0 for i in range(80))


def test_keys_reject_most_windows():
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(40))) for i in range(50)]
    index = decontaminate.Index(items, decontaminate.Spec())
    index.least[:] = 0  # every window is embedded
    ids = np.array([index.numbers.get(f"w{r.randrange(300)}".encode(), 0) for _ in range(20_000)] + [0] * 2 * decontaminate.PIECE)
    ((_, starts, hits, _),) = index.windows(ids)
    assert len(starts) == 20_000 and len(set(hits.tolist())) < 1_000


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Blue Whale"), (2, "vier"), (3, "one, two three four"), (4, "日本の首都はどこですか。"), (5, "ไทย"), (6, " ,. ")]
    rows = [
        (1, "a blue whale, and vier"), (2, "a blue small whale; four three two one"), (3, "x one two three four y"),
        (4, "問:日本の首都はどこですか?東京"), (5, "問:日本の古都はどこですか?京都"), (6, "日本の空"), (7, "คำว่า ไทย นะ"), (8, "one two four"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.edits, x.first_word, x.n_words) for x in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 1, 0, 1, 2), (1, 2, 0, 4, 1), (3, 3, 0, 1, 4), (4, 4, 0, 1, 11), (5, 4, 1, 1, 11), (7, 5, 0, 5, 3)}


# 4 ------------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.quality_classifier(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in held)


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = [(i, "bad junk " * 9 if i % 2 == 0 else "fine words here") for i in range(40)] + [(None, None), (77, ""), (78, "x" * 5000)]
    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(frame(spark, rows), labels).collect()}
    assert len(got) == 43 and got[0] < 0.5 < got[1] and got[None] == got[77]
    none = quality_classifier.quality_classifier(frame(spark, rows), labels.limit(0))
    assert {r.score for r in none.filter("doc_id = 77").collect()} == {0.5}
    assert quality_classifier.quality_classifier(frame(spark, []), labels).count() == 0


def test_training_uses_whole_texts():
    p = quality_classifier.Params()
    buckets, shares = quality_classifier.text_features(" ".join(f"word{i}" for i in range(3000)) + " farend", p)
    assert quality_classifier.bucket("farend", 0, p) in buckets and abs(shares.sum() - 1) < 1e-9


def test_training_follows_the_slope_of_the_loss():
    """Stochastic gradient descent said plainly: slopes by small differences of the weighted log loss."""
    p = quality_classifier.Params(buckets=8, dim=2, epochs=2, rate=0.3)
    r = np.random.default_rng(2)
    rows = [(int(i % 3 > 0), f := np.unique(r.integers(0, 8, 3)), np.full(len(f), 1 / len(f))) for i in range(6)]
    rng = np.random.default_rng(p.seed)
    vectors, out, offset = rng.uniform(-1 / p.dim, 1 / p.dim, (8, 2)), np.zeros((2, 2)), np.zeros(2)
    weight = {c: 6 / (2 * sum(y == c for y, _, _ in rows)) for c in (0, 1)}

    def loss(flat, row):
        v, o, b = flat[:16].reshape(8, 2), flat[16:20].reshape(2, 2), flat[20:]
        z = o @ (row[2] @ v[row[1]]) + b
        return weight[row[0]] * (np.log(np.exp(z).sum()) - z[row[0]])

    flat, speed = np.concatenate([vectors.ravel(), out.ravel(), offset]), np.array([20.0] * 16 + [1.0] * 4 + [0.1] * 2)
    for step, i in enumerate([i for _ in range(2) for i in rng.permutation(6)]):
        slope = np.array([(loss(flat + d, rows[i]) - loss(flat - d, rows[i])) / 2e-6 for d in np.eye(22) * 1e-6])
        flat = flat - p.rate * (1 - step / 12) * speed * slope
    model = quality_classifier.train(rows, p)
    assert model.weights == pytest.approx(flat[:16].reshape(8, 2) @ (flat[18:20] - flat[16:18]), abs=1e-5)
    assert model.bias == pytest.approx(flat[21] - flat[20], abs=1e-6)


def test_rows_that_share_a_labelled_id_are_one_row(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 3, 4)] * 3, "doc_id long, quality int")
    docs = frame(spark, [(0, "bad junk")] + [(1, f"fine words {i}") for i in range(300)] + [(3, "good"), (4, "poor")])
    learned = []
    held, quality_classifier.train = quality_classifier.train, lambda rows, p: learned.extend(rows) or quality_classifier.Model(np.zeros(p.buckets), 0.0, 0.5)
    try:
        quality_classifier.fit(docs, labels)
    finally:
        quality_classifier.train = held
    want = [i for i in (0, 1, 3, 4) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learned) == len(want)


def test_scorer_equals_the_averaged_vectors():
    p = quality_classifier.Params(buckets=1 << 10)
    w = np.random.default_rng(0).normal(size=p.buckets)
    model = quality_classifier.Model(w, 0.3, 0.5)
    text = "to to be or not to be"
    f, s = quality_classifier.text_features(text, p)
    assert quality_classifier.scorer(model, p)(text) == pytest.approx(1 / (1 + np.exp(-(0.3 + w[f] @ s))))


# 5 ------------------------------------------------------------------------------------------------------------------


def plain_removal(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd, levels, piece, run", [(1_000, 6, 1 << 21, 512), (1, 6, 1 << 21, 512), (1, 1, 1 << 21, 512), (2, 3, 64, 8), (1, 2, 50, 512)])
def test_suffix_dedup(spark, monkeypatch, crowd, levels, piece, run):
    for name, value in (("CROWD", crowd), ("LEVELS", levels), ("PIECE", piece), ("RUN", run)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(crowd)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage, texts = text(90), []
    for i in range(40):
        t = text(r.randint(0, 300))
        if i % 3 == 0:
            cut = r.randint(0, 20)
            t = t[:50] + passage[cut:] + t[50:]
        if i % 5 == 0:
            t += "xyz" * r.randint(10, 60)
        if i % 7 == 0 and texts:
            t = texts[-1]
        texts.append(t)
    for _ in range(30):  # near copies, as they crowd
        t = list(passage * 2)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice("abc")
        texts.append("".join(t))
    texts += [None, "", "same text in two rows " * 4, "same text in two rows " * 4]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length=40, gram=16).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == plain_removal(texts, 40)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got)


def test_runs_cover_all_strings_whatever_the_pieces():
    """Cut into pieces and runs of any size, every string start is in one run, under the smallest hash of its grams."""
    r = random.Random(12)
    held = suffix_dedup.PIECE, suffix_dedup.RUN
    try:
        for _ in range(40):
            data = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 700)))
            suffix_dedup.PIECE, suffix_dedup.RUN = r.choice([60, 100, 1 << 20]), r.choice([1, 5, 512])
            hashes, first, last, _ = suffix_dedup.runs_of(data, 40, 16)
            starts = sorted((p, h) for h, a, b in zip(hashes.tolist(), first.tolist(), last.tolist()) for p in range(a, b + 1))
            each = suffix_dedup.gram_hashes(np.frombuffer(data, np.uint8), 16) if len(data) >= 16 else []
            assert starts == [(p, int(min(each[p : p + 25]))) for p in range(len(data) - 39)]
            assert all(b - a < suffix_dedup.RUN for a, b in zip(first, last))
    finally:
        suffix_dedup.PIECE, suffix_dedup.RUN = held


def test_suffix_array():
    r = random.Random(3)
    for _ in range(100):
        body = bytes(r.choice(b"abc\n") for _ in range(r.randint(0, 200)))
        data = body + body[: r.randint(0, 60)] + b"\xff"
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 400)
        assert [data[i:] for i in order] == sorted((data[i:] for i in range(len(data))), key=lambda x: x + b"\xff" * 400)


# 6 ------------------------------------------------------------------------------------------------------------------


def test_codec_equals_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(0)
    texts = ["  Hello  world\n\tx é 😀 \u0000a", "a" * 3000, " " * 77 + "b", "漢字テスト。", "=====-----" * 30, "\n\n x\r\n", "internationalization" * 40]
    texts += ["".join(r.choice("abcdeilnorst  \n.é=") for _ in range(r.randint(1, 150))) for _ in range(200)]
    got = {x.doc_id: x for x in sentencepiece_codec.encode_documents(frame(spark, list(enumerate(texts)) + [(999, None)])).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == model.encode(t) and got[i].decoded == t and got[i].n_tokens == len(got[i].ids)
    assert (got[999].n_tokens, got[999].decoded) == (0, "")


def test_codec_streams_across_chunks():
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.codec_of(f.read())
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    text = "the quick brown fox jumps over it " * 40
    marked = "▁" + text.replace(" ", "▁")
    assert [i for p in codec.stream(marked) for i in codec.numbers(p)] == model.encode(text)
    assert codec.decode(codec.encode("a▁b")) == "a b"


# 7 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("min_near", [20, 0])
def test_line_dedup(spark, min_near):
    r = random.Random(5)

    def changed(s):
        i, c, k = r.randrange(len(s)) if s else 0, r.choice("abcé "), r.random()
        return s[:i] + c + s[i + 1 :] if k < 0.34 else s[:i] + s[i + 1 :] if k < 0.67 else s[:i] + c + s[i:]

    base = ["".join(r.choice("abcdefgh é") for _ in range(n)) for n in (1, 2, 3, 7, 15, 16, 17, 19, 20, 21, 22, 30, 31, 32, 33, 47, 48, 49, 64, 65, 200, 333, 9000) * 2]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(0, 5)):
            line = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                line = changed(line)
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rows += [(None, base[0]), (500, ""), (501, "\n\n"), (502, None)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in line_dedup(frame(spark, rows), min_near=min_near).collect()}
    assert got == brute.line_dedup(rows, min_near)
    assert dedup_documents(frame(spark, rows)).columns[:7] == frame(spark, rows).columns


# 8 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spec", [Spec(3, 90, 100), Spec(5, 80, 100)])
def test_jaccard_classes(spark, spec):
    r = random.Random(spec.words)
    text = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    line, base, texts = text(12), text(80), []
    for i in range(150):
        w = (base if i % 3 == 0 else text(r.randint(0, 60))).split()
        for _ in range(r.randint(0, 2)):
            if w:
                w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w) + (" " + line if i % 2 else ""))
        if i % 10 == 0:
            texts.append(texts[-1].upper())
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_classes(frame(spark, rows), spec).collect()}
    assert got == brute.components(rows, spec.words, spec.num, spec.den)


def test_every_link_is_counted(spark):
    r = random.Random(2)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(24):
        w = list(base)
        w[r.randrange(len(w))] = f"x{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w).upper() if i % 4 == 0 else f"alone {i} " * 9)]
    rows.append((99, None))
    sets = {i: frozenset(brute.shingles(t, 5)) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(near(s, o) for o in set(sets.values()) - {s} if s and o) for i, s in sets.items()}
    classes = jaccard_classes(frame(spark, rows), Spec(), every_link=True)
    got = {x.doc_id: (x.component_id, x.n_links) for x in classes.collect()}
    assert {i: n for i, (_, n) in got.items()} == want and max(want.values()) > 5
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (_, c) in brute.components(rows, 5, 80, 100).items()}


# 9 ------------------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    grant = next(t.text for t in license_scan.TEMPLATES if t.name == "mit_grant")
    dropped = " ".join(w for i, w in enumerate(grant.split()) if i % 20)
    rows = [
        (1, "Released under the MIT License, yes. mit-license again"), (2, "x " * 50 + grant), (3, "y " + dropped), (4, "the general\npublic LICENSE and Apache  license"),
        (5, "general license public"), (6, None), (7, ""), (8, "Licensed under CC BY-NC 4.0"), (9, "permit license é mit"), (9, "mit license"), (None, "MIT LICENSE"),
    ]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        w = brute.words(re.sub("[^\x00-\x7f]", "é", t or ""))
        want = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
        spots = {k: [j for j in range(len(w)) if w[j : j + len(v)] == v] for k, v in want.items()}
        places = [j for v in spots.values() for j in v]
        labels = ",".join(sorted(k for k, v in spots.items() if v))
        assert any(
            x.doc_id == i
            and (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), labels)
            and set(filter(None, labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
            for x in got
        )
    by = {x.doc_id: x for x in got}
    assert by[2].labels == by[3].labels == "mit" and by[2].score == 1 and by[8].labels == "cc-by-nc" and by[5].labels == ""


def _covered(words, template):
    """Brute force: the most template words in runs of LONG or more that stand in the text in order, with few words between."""
    k, best = license_scan.LONG, {}
    spots = [(p, a) for p in range(len(words) - k + 1) for a in range(len(template) - k + 1) if words[p : p + k] == template[a : a + k]]
    for p, a in sorted(spots):
        best[p, a] = max(
            [k] + [best[q, b] + min(k, a - b) for q, b in best if b < a and q < p and ((p - q == a - b and a - b < k) or (q + k <= p <= q + k + license_scan.GAP and b + k <= a))]
        )
    return max(best.values(), default=0) / len(template)


def test_notices_with_insertions(spark):
    texts = {t.name: t.text for t in license_scan.TEMPLATES}
    r = random.Random(8)
    noise = lambda n: [f"n{r.randrange(50)}" for _ in range(n)]
    mit = texts["mit_grant"].split()
    rows = [(1, " ".join(mit[:30] + noise(25) + mit[30:])), (2, " ".join(noise(90) + mit[:30] + noise(200) + mit[30:])), (3, texts["agpl_grant"]), (4, texts["lgpl_grant"]), (5, texts["gpl_grant"]), (6, " ".join(mit * 4)), (7, texts["boost"])]
    for i in range(8, 60):
        t = r.choice(license_scan.TEMPLATES).text.split()
        for _ in range(r.randint(0, 4)):
            o = r.randrange(len(t))
            t[o : o + r.randint(0, 3)] = noise(r.choice([0, 1, 8]))
            t = t or ["x"]
        rows.append((i, " ".join(noise(r.randint(0, 9)) + t + noise(r.randint(0, 9)))))
    got = {x.doc_id: x for x in license_scan.license_scan(frame(spark, rows)).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["mit", "", "agpl,gpl", "gpl,lgpl", "gpl", "mit", "boost"]
    assert [(s.first, s.last) for s in got[6].spans if s.template == "mit_grant"] == [(i * len(brute.words(texts["mit_grant"])), (i + 1) * len(brute.words(texts["mit_grant"])) - 1) for i in range(4)]
    for i, t in rows:
        words = [w.decode() for w in license_scan.text_words(t)]
        want = {x.name for x in license_scan.TEMPLATES if not x.base and not x.must and _covered(words, x.words) >= license_scan.SHARE}
        plain = {x.name for x in license_scan.TEMPLATES if not x.must}
        assert {s.template for s in got[i].spans} & plain == want


# 10 -----------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7} é</p>" * (i % 7), "d") for i in range(40)] + [(50, None, None, None), (51, "u\r\nv", "", "d"), (None, "n", "only", "d")]
    got = {r.page_id: r for r in warc_store.warc_round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(i if i is not None else -1, last.get(h or "", -1))
    for i, _, h, _ in rows:
        data, top = (h or "").encode(), last[h or ""]
        kind = ("response", None) if top in (i, -1) else ("revisit", top)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == kind
    assert warc_store.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_record_ids_are_unique_and_files_open(spark, tmp_path):
    rows = [(1, "a", "same", "d")] * 3 + [(2, "b", "same", "d"), (None, "n", "x", "d"), (None, "m", "x", "d")]
    bundles = warc_store.write_bundles(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    seen, records = set(), []
    for file in warc_store.export_files(bundles, str(tmp_path / "files")).collect():
        with open(file.file, "rb") as f:
            plain, at = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(), 0
        while at < len(plain):
            record, at = warc_store.parse_record(plain, at)
            seen.add(record["record_id"])
            records.append((record["page_id"], record["record_type"], record["refers_to"]))
    assert len(seen) == len(rows) and all(re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", x) for x in seen)
    assert sorted(records, key=repr) == sorted([(1, "revisit", 2)] * 3 + [(2, "response", None)] + [(None, "response", None)] * 2, key=repr)


def test_bundles_are_seekable(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " * 9000, "d") for i in range(60)]
    bundles = warc_store.write_bundles(spark.createDataFrame(rows, PAGES).repartition(2), str(tmp_path / "w"))
    one = bundles.first()
    frames = warc_store.read_seek_table(bytes(one.bundle))
    assert len(frames) > 1 and sum(c for _, c, _ in frames) < len(one.bundle)
    for page, frame_no, offset in zip(one.page_ids, one.frames, one.offsets):
        assert warc_store.read_at(bytes(one.bundle), frame_no, offset)["page_id"] == page
    # Readers that know nothing of the footer skip it.
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(one.bundle), read_across_frames=True).read()
    assert len(whole) == sum(d for _, _, d in frames)
    found = warc_store.lookup(bundles, spark.createDataFrame([(3,), (41,), (999,)], "k long")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(i, f"{i} " * 9000) for i in (3, 41)}
