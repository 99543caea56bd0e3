"""Plain versions of the operators, for small inputs."""

import random
import re

import sentencepiece
from pyspark.sql import SparkSession

from arbora.llm.quality_rules import RULES, STOP_WORDS
from arbora.llm.sentencepiece_codec import MODEL

BLANK = r"[ \t-\r]+"


def measures(text):
    text = text or ""
    words = [w for w in re.split(BLANK, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_stop": sum(w in STOP_WORDS for w in words), "n_exclaimed": sum(w.endswith("!") for w in words),
        "n_bullets": sum(bool(re.match(r"\s*[-*•]", x)) for x in lines),
        "n_ellipses": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    }


def kept(text):
    m = measures(text)
    if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
        return False
    for r in RULES:
        if m["n_words"] >= r.min_words:
            v = m[r.numerator] / m[r.denominator] if m[r.denominator] else None
            if v is not None and ((r.low is not None and v < r.low) or (r.high is not None and v > r.high)):
                return False
    return True


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    return a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]


def line_dedup(rows, shortest=20):
    """``{id: (lines, removed, text)}`` of ``(id, text)``; null ids come last."""
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        keep, n, gone = [], 0, 0
        for line in (text or "").split("\n"):
            if not re.search(r"[^ \t-\r]", line):
                keep.append(line)
                continue
            norm, n = re.sub(BLANK, " ", line.lower()).strip(" "), n + 1
            if any(norm == x or (min(len(norm), len(x)) >= shortest and one_edit(norm, x)) for x in seen):
                gone += 1
            else:
                keep.append(line)
            seen.append(norm)
        out[i] = (n, gone, None if text is None else "\n".join(keep))
    return out


def shingles(text, k):
    w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    low = {i: i for i in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                x, y = top(i), top(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def best_edits(item, text):
    """The smallest edit distance between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def pipeline_tables(spark: SparkSession):
    r = random.Random(9)
    vocab = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(200)]
    sentence = lambda n: " ".join(r.choice("the of and to in is".split()) if r.random() < 0.3 else r.choice(vocab) for _ in range(n))
    items = [sentence(20) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [sentence(r.randint(8, 25)) for _ in range(r.randint(1, 4))]
        if i % 7 == 1:
            lines.insert(1, items[i % 4])
        if i % 7 == 2 and rows:
            lines = rows[-2][1].split("\n") + lines[:1]
        if i % 7 == 3:
            lines = [x[:-1] + "q" for x in rows[-1][1].split("\n")]
        if i % 7 == 4 and rows:
            w = rows[-2][1].replace("\n", " ").split(" ")
            w[len(w) // 2] = "changed"
            lines = [" ".join(w)]
        if i % 11 == 5:
            lines = ["Junk### word*** here%%% now$$$ " * 5]
        rows.append((i, "\n".join(lines), "en", "s", len("\n".join(lines))))
    rows += [(60, "", "en", "s", 0), (61, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def pipeline(docs, bench):
    rows = [(d.doc_id, d.text) for d in docs if kept(d.text)]
    rows = [(i, t) for i, (n, gone, t) in line_dedup(rows).items() if not n or gone < n]
    groups = components(rows, 5, 80, 100)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [words(b.text) for b in bench]
    rows = [(i, t) for i, t in rows if all(best_edits(x, words(t)) > len(x) // 5 for x in items if len(x) >= 5)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {i: (len(ids := model.encode(t)), ids, t) for i, t in rows}
