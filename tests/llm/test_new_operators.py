"""Spelling variants, source divergence and toxicity against plain versions; nulls, empty and long texts, ties, repeats."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbora.llm import source_divergence as sd
from arbora.llm import spelling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, word string, n string, score string, `Key` int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, "x", "y", "z", 1) for i, t, lang, source in rows], SCHEMA)


# Spelling ----------------------------------------------------------------------------------------------------------


def plain_words(rows, p):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % p.drop_one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= p.min_length and c >= p.min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(words, p):
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= p.ratio * n else None
        out[w] = len(near)
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], out[w], words.get(form[w])))
    return rows


def spelled(seed, n=400):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(40)] + ["aaaaaaaa", "abababab", "Straße" * 2, "ÀÉÖ×÷ÿabc"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(0, 30)):
            w = r.choice(base[: r.choice((3, 12, len(base)))])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abz") + w[k:], w[:k] + r.choice("abz") + w[k + 1 :], w.upper()))
            words.append(w)
        rows.append((i % 300 if i % 17 else None, r.choice((" ", "\n", "1", "...")).join(words), "en", "s"))
    chain = " ".join(["kettle"] * 200 + ["kettla"] * 25 + ["kettaa"] * 3)
    return rows + [(i + 1000, chain, "en", "s") for i in range(10)] + [(7, None, "en", "s"), (8, "", "en", "s"), (9, "12 ..", "en", "s"), (10, "x" * 300_000 + " " + ("y" * 50_000 + " ") * 7, "en", "s")]


@pytest.mark.parametrize("letters,block", [(400_000, 32 << 20), (60, 4_000)])
def test_spelling_against_plain_version(spark, letters, block):
    p = spelling.Params(drop_one_in=7, shard_letters=letters, block_bytes=block)
    rows = spelled(3)
    got = {tuple(r) for r in spelling.spelling_variants(frame(spark, rows), p).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(plain_words(rows, p), p)
    assert got == want
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)  # forms, and forms of forms


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None, None, None)], [(1, "short words", "en", "s")]):
        assert spelling.spelling_variants(frame(spark, rows)).count() == 0


def test_trie_gives_all_neighbours():
    r = random.Random(5)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(0, 9))).encode(): 1 for _ in range(150)}
    words |= {b"": 2, b"a": 3, b"aa": 4}
    names = sorted(words)
    trie = spelling.Trie.unpack(spelling.Trie.of(names, [words[w] for w in names]).pack())
    for w in [*names, b"zzz", b"abz", b"zab"]:
        assert trie.neighbours(w) == {x: words[x] for x in names if one_edit(w, x)}
    one, two = trie.doors()
    assert one[ord("a")] and two[ord("b")] and not one[ord("z")]


def test_blocks_hold_every_shard_once():
    sizes = [("a", 5), ("b", 4), ("c", 90), ("d", 1), ("e", 1)]
    assert spelling.blocks(sizes, 10) == [("a", "b"), ("c", "c"), ("d", "e")]
    assert spelling.blocks([], 10) == []


# Divergence --------------------------------------------------------------------------------------------------------


def plain_divergence(rows, p):
    terms = [(lang or "", source or "", [t.translate(str.maketrans(spelling.UPPER, spelling.LOWER)) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in terms}:
        docs, groups = Counter(), defaultdict(Counter)
        for x, source, words in terms:
            if x == lang:
                docs.update(set(words))
                groups[source].update(words)
        kept = [t for t, n in docs.items() if n >= p.min_docs]
        share = lambda c: {t: 1 + p.scale * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        ps, all_ = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in groups.items():
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in groups if o != s]
            found = [(t, f(ps[s][t], all_[t])) for t in kept if c[t] and ps[s][t] > all_[t]]
            for part, items, most in (("pair", pairs, None), ("term", found, p.ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i) for i, (item, v) in enumerate(items[:most], 1)}
    return out


def sourced(seed, sources=23, n=500):
    r = random.Random(seed)
    words = [f"{c}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for c in "xyzé" for i in range(60)]
    rows = []
    for i in range(n):
        k = min(int(r.expovariate(0.15)), sources - 1)
        own = words[k * 7 % 200 :] + words[:9] * 3
        text = " ".join(r.choice(own if r.random() < 0.8 else words) for _ in range(r.randrange(0, 25)))
        rows.append((i, text if i % 31 else text.upper(), "en" if i % 3 else "fr", f"s{k}" if i % 41 else None))
    rows += rows[:5]
    return rows + [(1, None, None, None), (2, "", "de", "empty"), (2, "", "de", "other"), (3, "rare words only", "es", "s"), (4, "1 2 3", "en", "silent"), (5, "日本 語 ÀB" * 3000, "en", "s1")]


@pytest.mark.parametrize("settings", [{}, {"light_least": 2, "light_most": 3, "block": 5, "tile": 7, "held": 50, "small": 0, "ranks": 4, "cells": 9}, {"light_least": 500, "light_most": 500}])
def test_divergence_against_plain_version(spark, settings):
    p, rows = sd.Params(**settings), sourced(1)
    got = [tuple(r) for r in sd.source_divergence(frame(spark, rows), p).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, p)


def test_divergence_of_nothing(spark):
    assert sd.source_divergence(frame(spark, [])).count() == 0
    one = sd.source_divergence(frame(spark, [(1, "a b a b", "en", "s")] * 3)).collect()
    assert one == []  # a single group is no further from its language than itself


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13, 2 * 10**13), (0, 0)], "n long, total long")
    got = [r[0] for r in df.select(sd.share(F.col("n"), F.col("total"), sd.Params())).collect()]
    assert got == [1 + 10**9 * (10**13 + 1) // (2 * 10**13), 1 + 10**9]


# Toxicity ----------------------------------------------------------------------------------------------------------

BAD = ["idiot", "moron", "stupid", "worthless", "trash"]


def hidden(word, r):
    kind = r.randrange(4)
    if kind == 0:
        return "".join({"i": "1", "o": "0", "e": "3", "a": "4", "s": "$", "t": "7"}.get(c, c) if r.random() < 0.7 else c for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        k = r.randrange(len(word))
        return word[:k] + word[k] * r.randrange(4, 7) + word[k:]
    return word.upper()


def speech(seed, n=700):
    r = random.Random(seed)
    plain = ["the", "letter", "market", "of", "reason", "a", "report", "was", "note", "house", "meaning", "tree", "soon", "matter", "2024", "x"]
    rows, labels, seen = [], [], {}
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(8, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[3:3] = [r.choice(BAD) for _ in range(2)]
            words[r.randrange(len(words))] = r.choice(BAD)
        rows.append((i, " ".join(words) + r.choice(("", ".", "!!", "***")), "en", "s"))
        labels.append((i, int(toxic)))
        seen[i] = toxic
    return rows, labels, seen


def scored(spark, rows, labels, **settings):
    known = spark.createDataFrame([(i, t, "x") for i, t in labels], "doc_id long, toxic int, text string")
    return toxicity.toxicity(frame(spark, rows), known, toxicity.Params(**settings)).collect()


def test_toxicity_held_out_and_behind_disguise(spark):
    rows, labels, seen = speech(1)
    r = random.Random(9)
    # Disguised copies of held-out toxic rows, under ids that have no label.
    disguise = lambda t: " ".join(hidden(w, r) if w in BAD else w for w in t.split(" "))
    extra = [(10_000 + i, disguise(t), "en", "s") for i, t, *_ in rows if seen[i] and zlib.crc32(str(i).encode()) % 5 == 0]
    odd = [(None, None, "en", "s"), (20_001, "", "en", "s"), (20_002, " \n", "en", "s"), (20_003, "x", "en", "s"), (20_003, "x", "en", "s")]
    long = [(20_004, "the letter of reason " * 60_000, "en", "s"), (20_005, "a " * 100_000, "en", "s"), (20_006, "o" * 200_000, "en", "s")]
    got = scored(spark, rows + extra + odd + long, labels + [(5, None), (6, 1), (99_999, 1)])
    assert len(got) == len(rows + extra + odd + long)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [x for x in got if x.held_out and x.doc_id in seen and x.doc_id != 6]
    assert sum(x.predicted == seen[x.doc_id] for x in held) >= 0.98 * len(held) and len(held) > 100
    behind = [x for x in got if 10_000 <= (x.doc_id or 0) < 20_000]
    assert sum(x.predicted for x in behind) >= 0.9 * len(behind) and len(behind) > 20
    assert not any(x.predicted for x in got if x.doc_id is None or x.doc_id > 20_000)


def test_one_toxic_word_is_enough(spark):
    rows, labels, _ = speech(2)
    plain = " ".join(["the letter of the house was a report"] * 30)
    one = [(10_000 + i, f"{plain} {w} {plain}", "en", "s") for i, w in enumerate(BAD)] + [(10_100, plain, "en", "s")]
    got = {x.doc_id: x.predicted for x in scored(spark, rows + one, labels) if x.doc_id >= 10_000}
    assert got == {**{10_000 + i: 1 for i in range(len(BAD))}, 10_100: 0}


def test_toxicity_without_usable_labels(spark):
    rows = [(i, "some words here", "en", "s") for i in range(10)]
    assert {x.score for x in scored(spark, rows, [])} == {0.5}
    assert {x.score for x in scored(spark, rows, [(i, None) for i in range(10)])} == {0.5}
    assert all(x.predicted == 0 for x in scored(spark, rows, [(i, 0) for i in range(10)]))
    assert scored(spark, [], [(1, 0), (2, 1)]) == []


def test_weights_follow_numeric_slopes():
    """One full step on a single batch moves against the slope of the mean log loss."""
    r = np.random.default_rng(2)
    names = [f"f{i}" for i in range(6)]
    rows = [(int(r.random() < 0.5), np.array(sorted(r.choice(6, 3, replace=False)))) for _ in range(20)]
    weight = {0: 0.5, 1: 1.5}
    p = toxicity.Params(epochs=1, rate=1e-6, shrink=0.0, hide=0.0)

    def loss(w, b):
        out = 0.0
        for label, there in rows:
            z = b + w[there].sum()
            out += weight[label] * (np.log1p(np.exp(z)) - label * z)
        return out / len(rows)

    model = toxicity.train(rows, names, weight, p)
    moved = np.array([model.weights[f] for f in names])
    slopes = np.array([(loss(np.eye(6)[i] * 1e-6, 0.0) - loss(-np.eye(6)[i] * 1e-6, 0.0)) / 2e-6 for i in range(6)])
    assert np.all(np.sign(moved) == -np.sign(slopes))
    # The step is the slope over its root mean square: all of one size.
    assert np.allclose(np.abs(moved), 1e-6, rtol=0.01)


def test_trigrams_against_plain_count(spark):
    rows, *_ = speech(3, 50)
    rows += [(1, None, "en", "s"), (2, "Größe 42x ЖЖ", "en", "s")]
    want = Counter()
    for _, text, *_ in rows:
        for word in re.findall(r"[^\W_]+", (text or "").lower()):
            s = [0, 0, *map(toxicity.symbol, word), 0]
            want.update((a * toxicity.SIZE + b) * toxicity.SIZE + c for a, b, c in zip(s, s[1:], s[2:]))
    got = {r.gram: r.n for r in toxicity.trigram_counts(frame(spark, rows).select("text")).collect()}
    assert got == dict(want)
    model = toxicity.log_model(np.array(list(want)), np.array(list(want.values())))
    assert np.allclose(np.exp(model.astype(float)).sum(axis=2), 1, atol=1e-4)


def test_viterbi_against_enumeration():
    """The decoder's reading has the least cost of all readings of the lattice."""
    r = np.random.default_rng(4)
    model = np.log(r.dirichlet(np.full(toxicity.SIZE, 0.05), (toxicity.SIZE, toxicity.SIZE)) + 1e-9).astype(np.float32)
    p = toxicity.Params()
    decoder = toxicity.Decoder(model, p)
    cost = -model.astype(float)

    def readings(span):
        done = [(0.0, "", (0, 0))]
        for i, c in enumerate(span):
            run = len(re.match(re.escape(c) + "*", span[i:]).group()) + len(re.search(re.escape(c) + "*$", span[:i]).group())
            again, new = (p.repeat if run > 2 else p.double), []
            for spent, text, (a, b) in done:
                for s, out, extra in decoder.readings(c):
                    if not out:
                        new.append((spent + extra * (b != 0), text, (a, b)))
                    elif s == 0:
                        new.append((spent, text, (a, b)) if b == 0 else (spent + cost[a, b, 0], text + " ", (0, 0)))
                    else:
                        new.append((spent + extra + cost[a, b, s], text + out, (b, s)))
                        if text.endswith(out):
                            new.append((spent + extra + again, text, (a, b)))
            done = new
        return min((spent + (cost[a, b, 0] if b else 0), text) for spent, text, (a, b) in done)

    for span in ("1d10t", "l.o.s", "aab", "ooo0", "a b c", "$$a", "x!!y", "a-", "zz1"):
        _, text = readings(span)
        assert decoder.viterbi(span).split() == text.split()


# Licences ----------------------------------------------------------------------------------------------------------


def test_identifiers_versions_and_whole_texts(spark):
    from arbora.llm import license_scan

    said = {
        "// SPDX-License-Identifier: Apache-2.0": "apache", "# SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
        "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: Proprietary": "", "SPDX License Identifier list": "",
        "Licensed under CC BY-SA 3.0.": "cc-by-sa", "licensed under CC BY 2.5": "cc-by", "Licensed under CC BY-NC-ND 2.0": "cc-by-nc-nd", "Licensed under CC 3.0": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "cc-by-sa",
        "1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.": "apache",
        "Preamble. The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to "
        "guarantee your freedom to share and change free software--to make sure the software is free for all its users.": "gpl",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
        "Attribution-NonCommercial 4.0 International Public License (\"Public License\").": "cc-by-nc",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and "
        "subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database": "cc0",
        "Licences for most software are designed for users, and freedom to share and change is a matter of taste.": "",
    }
    r = random.Random(1)
    noise = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(40))
    rows = [(i, f"{noise()}\n{text}\n{noise()}", "en", "s") for i, text in enumerate(said)]
    got = {x.doc_id: x.labels for x in license_scan.license_scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
    ids = [t for t in license_scan.made_templates()]
    assert len({t.name for t in ids}) == len(ids) and all(t.needed for t in ids)


# Pages -------------------------------------------------------------------------------------------------------------


def test_hidden_inline_parts_are_no_text():
    from arbora.llm import html_extract

    pages = {
        "<p>Visible <span style='display:none'>SECRET</span> more</p>": ["Visible more"],
        "<p>a <span hidden>b <span>c</span> d</span> e</p>": ["a e"],
        "<p>a <i aria-hidden=\"true\">icon</i>b <i aria-hidden=false>c</i></p>": ["a b c"],
        "<p>a <b style='visibility: HIDDEN'>never closed<p>next</p>": ["a", "next"],
        "<p>a <a hidden href=x>b<br>c</a> d <span class=hidden-phone>e</span></p>": ["a d e"],
        "<p>display <em title='hidden'>stays</em></p>": ["display stays"],
    }
    for page, want in pages.items():
        assert [b.text for b in html_extract.blocks_of(page)] == want, page


def test_pages_laid_out_by_tables_and_unknown_names():
    from arbora.llm import html_extract

    extract = html_extract.extractor(html_extract.trained())
    one = "The farmers of the valley brought in a good harvest this year, after a long and dry summer that worried many."
    two = "Prices fell as the markets filled, and the mills worked through the night to grind what came."
    left = "<td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>Contact us</a></td>"
    right = "<td><b>Sponsors</b><br><a href=/x>Tractor world</a> <a href=/y>Seeds now</a></td>"
    foot = "<tr><td colspan=3>Copyright 2020 Valley Gazette</td></tr>"
    article = f"<h2>The harvest of the year</h2><p>{one}</p><p>{two}</p>"
    want = f"The harvest of the year {one} {two}"
    assert extract(f"<html><body><table><tr>{left}<td>{article}</td>{right}</tr>{foot}</table></body></html>") == want
    assert extract(f"<html><body><table><tr>{left}<td>{article}</td></tr>{foot}</table></body></html>") == want
    tail = '<div class="user-reactions"><h3>Reactions</h3><div class="reaction"><p>Finally! I waited for this so long.</p></div></div><div class="site-info">About us - Imprint - Privacy</div>'
    top = '<div class="topbar"><a href=/>Gazette</a> <a href=/s>Sport</a> <a href=/w>World</a></div>'
    assert extract(f'<html><body>{top}<div class="story-wrap">{article}</div>{tail}</body></html>') == want


# Odd rows of earlier operators -----------------------------------------------------------------------------------------


def test_long_texts_in_every_stage(spark, tmp_path):
    """A text of some MB, and one whose single line is as long, go through all stages and come out whole."""
    import corpus_pipeline

    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "and", "to"]) if r.random() < 0.3 else f"w{r.randrange(90_000)}"
    lines = "\n".join(" ".join(word() for _ in range(12)) for _ in range(15_000))
    one = " ".join(word() for _ in range(150_000))
    docs = spark.createDataFrame([(1, lines, "en", "s", 0), (2, one, "en", "s", 0), (3, lines + "\nan end of its own", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "none of these words stands in any of the texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert {x.doc_id for x in stage["quality_rules"](spark, docs, "").collect()} == {1, 2, 3}
    lined = {x.doc_id: x.text for x in stage["line_dedup"](spark, docs, "").collect()}
    assert lined == {1: lines, 2: one, 3: "an end of its own"}
    assert {x.doc_id for x in stage["jaccard_join"](spark, docs, "").collect()} == {1, 2}
    assert {x.doc_id for x in stage["benchmark_decontamination"](spark, docs, str(tmp_path)).collect()} == {1, 2, 3}
    tokens = {x.doc_id: x.decoded for x in stage["sentencepiece"](spark, docs.filter("doc_id = 2"), "").collect()}
    assert tokens == {2: one}


def test_long_texts_are_classified_whole(spark):
    from arbora.llm import quality_classifier

    rows, labels = [], []
    for i in range(200):
        good = i % 2
        rows.append((i, " ".join(["careful", "reasoned", "measured"] if good else ["buy", "cheap", "now"]) + f" word{i}", "en", "s"))
        labels.append((i, good))
    tail = "plain " * 5 + "careful reasoned measured " * 200_000
    rows += [(1000, tail, "en", "s"), (1001, tail[: len("plain ") * 5] + "buy cheap now " * 200_000, "en", "s"), (1000, tail, "en", "s")]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = [(x.doc_id, x.score) for x in quality_classifier.quality_classifier(frame(spark, rows), known).collect()]
    assert len(got) == len(rows)
    scores = dict(got)
    assert scores[1000] > 0.7 > 0.3 > scores[1001] and sum(i == 1000 for i, _ in got) == 2


def test_repeated_rows_of_leaks_and_spans(spark):
    from arbora.llm import decontaminate, suffix_dedup

    item = "a passage of words that only the benchmark and one of the texts have in common today"
    rows = [(1, f"before {item} after", "en", "s")] * 3 + [(2, "nothing of the kind " * 20, "en", "s")] * 2 + [(None, f"x {item}", "en", "s")] * 2
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    found = Counter((x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, rows), bench).collect())
    assert {k for k in found} == {(1, 7), (1, 8), (None, 7), (None, 8)}
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh") for _ in range(600))
    rows = [(None, text, "en", "s")] * 150 + [(1, "".join(r.choice("ijkl") for _ in range(600)), "en", "s")]
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == {(None, 600, 600, 1): 150, (1, 600, 0, 0): 1}
