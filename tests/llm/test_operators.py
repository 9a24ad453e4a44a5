"""Each operator against a plain-Python version on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tilewright.llm import chat, chunks, language, licenses, neardup, packing, pieces, queries, tokencounts, tokenfile
from tilewright.llm import quality as quality_module
from tilewright.llm.quality import learn_references, learning_sample, quality

SF = "/root/testdata/sf0.001"
WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "A b c d e A b c d e f"), (6, "x " * 30000), (7, "a\x1cb İstanbul ßTRASSE naïve, 日本語。"),
    (8, "<|endoftext|> </s>[INST] ok [/INST] [\\INST]"), (9, "MIT License. mit license"), (9, "MIT License. mit license"), (10, "\u00a0\u2003z\u0085"), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    return d.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text")).withColumn("kept", F.lit(7)).withColumn("SCORE", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def class_counts(t):
    found = [len(re.findall(c, t)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[ \\t-\\r]", "[.,;:!?()\"'-]", "[^\\x00-\\x7f]")]
    return [*found, len(t) - sum(found)]


def js_distance(p, q):
    half = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, sum(x * math.log2(x / m) for a in (p, q) for x, m in zip(a, half, strict=True) if x > 0) / 2))


def test_quality(spark, docs, odd):
    for d in (docs, odd):
        known = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        found = rows(quality(d).drop("text"))
        assert len(found) == len(known)
        want = Counter()
        for doc_id, text in known:
            w = words_of(text)
            windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
            lines = [x for x in (text or "").split("\n") if words_of(x)]
            failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
            want[(doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed)] += 1
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert Counter(tuple(r[n] for n in names) for r in found) == want
        assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality(docs.limit(0)).count() == 0


def test_quality_separates_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality(docs).where(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] > 0.98 and share[0] < 0.2


ITALIAN = (
    "Il vecchio pescatore guardava ogni mattina il mare dalla finestra della sua piccola casa. Quando il vento soffiava forte, restava seduto "
    "accanto al fuoco e raccontava ai nipoti le storie della sua giovinezza, quando navigava verso isole lontane con i suoi fratelli. Loro ascoltavano "
    "in silenzio, perché ogni storia finiva sempre con una sorpresa, e nessuno voleva perdere neppure una parola del racconto. "
)


def letters(n, seed=5):
    r = random.Random(seed)
    said = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w for i, w in enumerate(said))


def test_quality_rejects_texts_without_common_words(spark):
    known = [(1, letters(480)), (2, letters(60)), (3, letters(5000)), (4, ITALIAN)]
    d = spark.createDataFrame(known, "doc_id long, text string")
    said = learn_references(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r.doc_id: r for r in quality(d, references=said).collect()}
    assert not any(r.base_failed for r in got.values()) and not any(r.kept for r in got.values())
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").repartition(8)
    sizes = F.when(F.col("n_words") < 100, 0).when(F.col("n_words") < 400, 1).otherwise(2)
    rated = quality(docs).where("not base_failed and n_words >= 40").groupBy(sizes.alias("s"), "quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    assert all(r.k > 0.98 if r.quality else r.k < (0.02 if r.s else 0.15) for r in rated.collect())


def sample_of(pattern, most):
    """A text that the pattern matches: with all optional parts and last branches, or without any and with first ones."""
    from re import _constants as C
    from re import _parser

    def walk(tree):
        out = ""
        for op, arg in tree:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.NOT_LITERAL:
                out += "z"
            elif op is C.IN:
                out += chr(arg[-1 if most else 0][1])
            elif op is C.BRANCH:
                out += walk(arg[1][-1 if most else 0])
            elif op is C.SUBPATTERN:
                out += walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = arg
                out += walk(inner) * ((3 if high > 99 else min(high, 3)) if most else low)
            else:
                raise AssertionError(op)
        return out

    return walk(_parser.parse(pattern))


def test_every_license_rule_matches_its_samples(spark):
    said = [(2 * i + most, sample_of(r[1], most)) for i, r in enumerate(licenses.RULES) for most in (0, 1)]
    assert all(re.fullmatch(licenses.RULES[i // 2][1], t) for i, t in said)
    got = {r.doc_id: (r.base_labels, r.labels, len(r.detections), [(d.start, d.end) for d in r.detections]) for r in licenses.license_scan(spark.createDataFrame(said, "doc_id long, text string").repartition(4)).collect()}
    for i, t in said:
        want = brute_licenses(t)
        assert (got[i][0], got[i][1], got[i][2]) == want[4:7], (t, got[i], want)
        assert sorted(got[i][3]) == brute_places(t)


def brute_licenses(text):
    w = [x for x in re.split(licenses.BREAKS, text or "") if x]
    w = [x.translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for x in w]
    base = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    spans = []
    for no, (label, pattern, level, *_groups) in enumerate(licenses.RULES):
        for i in range(len(w)):
            m = re.match(f"(?:{pattern})(?= )", " ".join(w[i : i + 60]) + " ")
            if m:
                spans.append((i, i + len(m[0].split()), level, no, label))
    kept = suppressed(spans)
    labels = sorted({b[1] for b in base} | {k[4] for k in kept})
    return len(w), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(sorted({b[1] for b in base})), ",".join(labels), len(kept)


def suppressed(spans):
    return [a for a in spans if not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and (b[2], b[0] - b[1], b[3]) < (a[2], a[0] - a[1], a[3]) for b in spans)]


def brute_places(text):
    w = [x.lower() for x in re.split(licenses.BREAKS, text or "") if x]
    spans = []
    for no, (label, pattern, level, *_groups) in enumerate(licenses.RULES):
        for i in range(len(w)):
            m = re.match(f"(?:{pattern})(?= )", " ".join(w[i : i + 60]) + " ")
            if m:
                spans.append((i, i + len(m[0].split()), level, no, label))
    return sorted((a[0], a[1]) for a in suppressed(spans))


def test_licenses(spark, odd):
    assert len(licenses.RULES) > 200
    said = [
        "Released under the GNU General Public License, version 3 or later. gnu general public license gnu general public license",
        "SPDX-License-Identifier: Apache-2.0 and cc by cc by-nc-sa 4.0, all rights reserved", "3-Clause BSD License or BSD-3-Clause", "GNU Lesser General Public License v2.1; the unlicense; der mit dem",
        "see the file LICENSE for details", "Licensed under the terms of the Mozilla Public Licence 2.0",
    ]
    d = odd.select("doc_id", "text").where("doc_id <> 6").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(said)], "doc_id long, text string"))
    some = spark.read.parquet(f"{SF}/documents.parquet").where("lower(text) like '%licens%' or lower(text) like '%rights%'").select("doc_id", "text").limit(25)
    for frame in (d, some):
        known = [(r.doc_id, r.text) for r in frame.collect()]
        frame = spark.createDataFrame(known, "doc_id long, text string")
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, len(r.detections)) for r in licenses.license_scan(frame).collect())
        assert got == Counter((i, *brute_licenses(t)) for i, t in known)


def test_license_rules_that_start_inside_their_match(spark):
    """However often a rule starts inside its own match, and however long the text is, the match is read whole."""
    rule = ("many", "a (?:a ){0,60}z", 1, ["z"], ["z"], ["z"])
    known = [(1, "b " + "a " * 40 + "z b"), (2, "a z"), (3, "a " * 7 + "z"), (4, "a " * 80), (5, "word " * 40_000 + "a a z " + "word " * 40_000 + "MIT license")]
    d = spark.createDataFrame(known, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(d, rules=[rule]).collect()}
    assert {k: [(x.start, x.end, x.label) for x in r.detections] for k, r in got.items()} == {1: [(1, 42, "many")], 2: [(0, 2, "many")], 3: [(0, 8, "many")], 4: [], 5: [(40_000, 40_003, "many")]}
    assert (got[5].n_base, got[5].first_word, got[5].n_words) == (1, 80_003, 80_005)


def jaccard_components(known, k, percent):
    sets = {}
    for doc_id, text in known.items():
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_texts(n=60, seed=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = f"z{r.randrange(9999)}"
        out[i + 1] = " ".join(w)
    out |= {n + 1 + i: " ".join(f"q{r.randrange(5000)}" for _ in range(40)) for i in range(20)}
    return out | {200: None, 201: "", 202: "two words", 203: "Two WORDS"}


@pytest.mark.parametrize("limits", [(4096, 512), (4096, 16), (16, 8)])
def test_near_duplicates(spark, limits):
    known = near_texts(120)
    d = spark.createDataFrame(list(known.items()), "doc_id long, text string").withColumn("rep", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, words=4, max_group=limits[0], task_rows=limits[1]).collect()}
    assert got == jaccard_components(known, 4, 80)


def test_near_duplicates_of_documents(spark, docs):
    known = texts(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, words=4).collect()}
    assert got == jaccard_components(known, 4, 80)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_learned_references(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    found = learn_references(docs)
    known = sorted({(r.lang, r.text) for r in docs.where("lang is not null and text is not null").collect()})
    for lang, ref in found.items():
        own = [t for k, t in known if k == lang]
        whole = [sum(c) for c in zip(*map(class_counts, own), strict=True)]
        first = [x / sum(whole) for x in whole]
        said = [t for t in own if len(t) < 200 or js_distance([x / len(t) for x in class_counts(t)], first) <= 0.25]
        assert len(own) * 0.8 < len(said) < len(own)
        counts = Counter(w for t in said for w in words_of(t))
        want = sorted(((w, n) for w, n in counts.items() if regex.fullmatch(r"[\p{L}\p{M}]+", w)), key=lambda x: (-x[1], x[0].encode()))[:10]
        assert list(ref["words"]) == [w for w, _ in want] and abs(ref["words"][want[0][0]] - want[0][1] / sum(counts.values())) < 1e-12
        assert np.allclose(ref["chars"], np.sum([class_counts(t) for t in said], axis=0) / sum(map(len, said)), atol=1e-12)
    assert sorted(found) == sorted({k for k, _ in known})
    kept = quality(docs, references=found).where("not base_failed").join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int")).alias("k")).first().k
    assert kept > 0.95
    assert learn_references(docs.limit(0)) == {}


def test_quality_learning_sample(spark):
    """The distinct texts of lowest md5; copies count once, and only the languages with the most rows are drawn from."""
    said = [(lang, f"text {i} of {lang}") for lang, n in (("aa", 90), ("bb", 40), ("cc", 5)) for i in range(n)]
    rows = [*said, *(("bb", "text 3 of bb") for _ in range(200)), ("aa", None), (None, "no lang"), ("aa", "")]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for bound, most, langs in ((7, 64, "aa bb cc"), (1000, 2, "aa bb"), (3, 1, "bb")):
        want = {(k, t) for k in langs.split() for t in sorted({x for q, x in rows if q == k and x is not None}, key=md5)[:bound]}
        got = [(r.l, r.t) for r in learning_sample(d, bound, most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert learning_sample(d.limit(0)).count() == 0


def labelled_beyond_a_sample(spark):
    """2000 short labelled texts of lowest md5 in other words than the 100 long ones after them, copies of both, and one text without a lang in the long ones' words."""
    r = random.Random(5)
    low = lambda t: hashlib.md5(t.encode()).hexdigest() < "8"
    said = "stone river cloud field house light water green north wind".split()
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    short = [t for t in (f"only {name(i)}" for i in range(9000)) if low(t)][:2000]
    long = [t for t in (" ".join(r.choices(said, k=400)) for _ in range(400)) if not low(t)][:100]
    known = [*short, *short[:50], *long, *long[:9], *long[:9]]
    rows = [(i, t, "xx") for i, t in enumerate(known)] + [(10_000, "12 | 34 | " * 60, "xx"), (9999, " ".join(r.choices(said, k=60)), None)]
    d = spark.createDataFrame([(*x, None, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    return d, short + long, said


def test_quality_learns_from_all_texts(spark):
    """Every text counts once, however many a language has; copies and texts far from their language do not."""
    d, texts, said = labelled_beyond_a_sample(spark)
    found = learn_references(d)["xx"]
    counts = Counter(w for t in texts for w in t.split())
    want = sorted(((w, n) for w, n in counts.items()), key=lambda x: (-x[1], x[0]))[:10]
    assert found["words"] == {w: n / sum(counts.values()) for w, n in want} and set(said) & set(found["words"])
    assert np.allclose(found["chars"], np.sum([class_counts(t) for t in texts], axis=0) / sum(map(len, texts)), atol=1e-12)
    assert quality(d).where("doc_id = 9999").first().kept


def test_quality_compares_own_words_only(spark, monkeypatch):
    """A text is compared with each language's own words, however many languages there are; the distances are those over all words."""
    lengths = []
    shares = quality_module._shares
    monkeypatch.setattr(quality_module, "_shares", lambda r: lengths.append(len(r)) or shares(r))
    names = [chr(97 + i) for i in range(8)]
    said = {k: {"chars": [0.7, 0.1, 0.01, 0.15, 0.02, 0.01, 0.01], "words": {"both": 0.1} | {k * (n + 1): 0.02 * (n + 1) for n in range(6)}} for k in names}
    vocabulary = sorted({w for r in said.values() for w in r["words"]})
    words = "both both b bb bbb c cc cccccc other words stand here".split() * 4
    got = quality(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), references=said).first()
    p = [words.count(v) / len(words) for v in vocabulary]
    want = min(js_distance([*p, 1 - sum(p)], [*(r["words"].get(v, 0.0) for v in vocabulary), 1 - sum(r["words"].values())]) for r in said.values())
    assert abs(got.word_distance - want) < 2e-6
    assert sorted(set(lengths)) == [7, 8]


def test_quality_references_of_odd_labels(spark):
    # no label, one with few words, one without letters, one written without spaces, a tie in rank
    plain = "the river ran past the old mill and the children threw stones into the water until the sun went down behind the hill "
    cjk = ["".join(chr(0x4E00 + (i * 37 + j * j) % 1300) for j in range(300)) for i in range(1200)]
    known = [(1, None, None), (2, None, "en"), (3, plain * 60, "en"), (4, "few words only", "xx"), (5, "1 2 3 4 5 " * 300, "no"), (6, " ".join(random.Random(1).sample((plain * 3).split(), 69)), None)]
    known += [(100 + i, t, "zh") for i, t in enumerate(cjk)]
    d = spark.createDataFrame(known, "doc_id long, text string, lang string")
    found = learn_references(d)
    assert sorted(found) == ["en", "no", "zh"] and found["no"]["words"] == {} and list(found["en"]["words"])[0] == "the"
    assert list(learn_references(d, max_languages=1)) == ["zh"]
    got = {r.doc_id: r for r in quality(d).collect()}
    assert len(got) == len(known) and got[6].kept and got[6].word_distance < 0.2
    # Chinese without spaces has no common words: only its characters say something
    many = spark.createDataFrame([(1, " ".join(cjk[:60])), (2, letters(480))], "doc_id long, text string")
    said = {r.doc_id: r.kept for r in quality(many, references={"zh": found["zh"]}).collect()}
    assert said == {1: True, 2: False}
    # nothing to compare with: the base rules alone
    bare = {r.doc_id: r for r in quality(many).collect()}
    assert bare[1].kept and bare[1].char_distance is None and bare[1].word_distance is None
    assert [r.kept for r in quality(many, references={"no": found["no"]}).orderBy("doc_id").collect()] == [False, False]


def test_quality_distances(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = learn_references(docs)
    vocabulary = sorted({w for r in found.values() for w in r["words"]})

    for r in quality(docs).orderBy("doc_id").limit(60).collect():
        w, t = words_of(r.text), r.text or ""
        shares = [x / len(t) for x in class_counts(t)] if t else []
        said = [w.count(v) / len(w) for v in vocabulary] if w else []
        chars = min(js_distance(shares, x["chars"]) for x in found.values()) if len(t) >= 200 else None
        word = min(js_distance([*said, 1 - sum(said)], [*(x["words"].get(v, 0.0) for v in vocabulary), 1 - sum(x["words"].values())]) for x in found.values()) if len(w) >= 40 else None
        assert (r.char_distance is None) == (chars is None) and (chars is None or abs(r.char_distance - chars) < 2e-6)
        assert (r.word_distance is None) == (word is None) and (word is None or abs(r.word_distance - word) < 2e-6)


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_language_kernel():
    """Equal to the kernel on sets of n-grams, in any script, however many characters there are."""
    r = random.Random(7)
    han, hangul = (["".join(chr(base + r.randrange(size)) for _ in range(2500)) for _ in range(2)] for base, size in ((0x4E00, 12000), (0xAC00, 11000)))
    said = [
        "der Hund schläft, und die Katze wacht", "the dog sleeps while the cat is awake", "Старик каждое утро смотрел на море из окна своего дома", *han, *hangul,
        "mixed 日本語 и русский \U0001f600 text \U0010fffd", "abc abc abc", "a",
    ]
    model = language.fit(said, ["de", "en", "ru", "zh", "zh", "ko", "ko", "x", "x", "x"], landmarks=3)
    other = [*said, "ein Satz mit anderen Wörtern", "q", "zz zz zz zz", han[0][:40] + hangul[0][:40], "\x00\x00a", "中"]
    got = model.kernel(other)
    # landmarks of a language come in the order of the texts
    for row, text in zip(got, other, strict=True):
        for value, mark in zip(row, said, strict=True):
            a, b = grams(text), grams(mark)
            assert abs(value - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-6
    x, own, _ = model.presence(other)
    assert own.ravel().tolist() == [len(grams(t)) for t in other]


def test_language_weights():
    """Scores are those of ridge regression on Nyström features, worked out once more from sets of n-grams."""
    docs = {"en": ["the old man went to the sea", "a ship came over the sea", "the wind and the rain"], "de": ["der alte Mann ging an das Meer", "ein Schiff kam über das Meer", "der Wind und der Regen"]}
    texts_, labels = [t for ts in docs.values() for t in ts], [k for k, ts in docs.items() for _ in ts]
    model = language.fit(texts_, labels, landmarks=2, ridge=0.05)
    marks = [t for ts in docs.values() for t in ts[:2]]
    k = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    to = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    x = np.array([[k(a, b) for b in marks] for a in texts_]) @ to
    y = np.array([[float(q == lang) for lang in sorted(docs)] for q in labels])
    centred = x - x.mean(axis=0)
    solved = np.linalg.solve(centred.T @ centred + 0.05 * len(texts_) * 0.01 * np.eye(x.shape[1]), centred.T @ (y - y.mean(axis=0)))
    new = ["the sea", "das alte Schiff", "rain und wind", texts_[0]]
    want = (np.array([[k(a, b) for b in marks] for a in new]) @ to - x.mean(axis=0)) @ solved + y.mean(axis=0)
    seen, own, shares = model.presence(new)
    assert np.allclose(model._kernel(seen, own) @ model.weights + model.bias, want, atol=1e-5)
    # a text's share of 3-grams common in a language, repeats counted
    common = [{g for g, n in Counter(g for t in docs[lang] for g in grams(t) if len(g) == 3).items() if n >= 2} for lang in sorted(docs)]
    for row, t in zip(shares, new, strict=True):
        every = [t.lower()[i : i + 3] for i in range(len(t) - 2)]
        assert np.allclose(row, [sum(g in c for g in every) / len(every) for c in common])


def test_language_ties_go_to_the_first_in_order():
    same = ["one text of both", "and another one", "the third of them"]
    model = language.fit(same * 2, ["bb"] * 3 + ["aa"] * 3, landmarks=3)
    assert [model.languages[k] for k in model.best([*same, "one more text"])[0]] == ["aa"] * 4


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    known = [(1, "½ ²"), (1, "½ ²"), (2, "٣ _ 12"), (3, None), (4, "x" * 100_000), (None, "Ⅷ"), (5, "the and of")]
    d = spark.createDataFrame(known, "doc_id long, text string").withColumn("LANG_PRED", F.lit(5)).withColumn("kernel", F.lit("x"))
    found = language.identify(d, model)
    assert found.columns == ["doc_id", "text", "kernel", "lang_pred", "score"]
    got = Counter((r.doc_id, r.lang_pred == "und") for r in found.collect())
    assert got == Counter([(1, True), (1, True), (2, True), (3, True), (4, False), (None, True), (5, False)])
    many = spark.range(50).select(F.col("id").alias("doc_id"), F.format_string("l%d", F.col("id") % 25).alias("lang"), F.format_string("text number %d", "id").alias("text"))
    assert len(language.train(many, max_languages=4).languages) <= 4


def test_word_encoder_depends_on_nothing_before():
    from tokenizers import Tokenizer

    from tilewright.llm.tokens import WordEncoder

    library, own = Tokenizer.from_file(WORD_BPE), WordEncoder(WORD_BPE, limit=500)
    r = random.Random(1)
    pool = [*"abcXYZ'’.,;:!?-_*&()[]<>|/\\\"@#09 \t\n", *"İıßÉéñÇŒŠžǅªº½²٣ΣςЖжあ日本語\u0301\u0302\u0307 \x1c\x1f\x85\u00a0\u2003\u200b\ufeff\u0345ẞŉµ", "<|endoftext|>", "'s", "'LL", "the", "word", "</w>", "\U0001f600", "\0"]
    texts = ["İ", "İ.", "İ", "é.", "e\u0301.", *["".join(r.choices(pool, k=r.randrange(1, 14))) for _ in range(30_000)]]
    got = own.encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.identify(docs, model).where(language.held_out("doc_id")).where("lang_pred <> 'und'").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    strange = Counter((r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect())
    assert strange[(1, "und")] == strange[(2, "und")] == strange[(3, "und")] == 1 and strange[(9, "und")] == 0
    assert language.identify(odd, language.train(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_training_sample_keeps_every_language(spark):
    hot = spark.range(3000).select("id", F.lit("aa").alias("lang"), F.format_string("word%d of few", F.col("id") % 7).alias("text"))
    long = spark.range(9).select("id", F.lit("bb").alias("lang"), F.repeat(F.format_string("long%d text ", "id"), 900).alias("text"))
    many = spark.range(500).select("id", F.lit("cc").alias("lang"), F.format_string("one of many %d", "id").alias("text"))
    docs = hot.union(long).union(many).withColumnRenamed("id", "doc_id")
    got = defaultdict(list)
    for r in language.training_sample(docs, 5, 8000).collect():
        got[r.lang].append((r.r, r.text))
    assert {k: len({t for _, t in v}) for k, v in got.items()} == {"aa": 5, "bb": 5, "cc": 5}
    assert all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values()) and all(len(t) <= 8000 for v in got.values() for _, t in v)
    assert language.train(docs).languages == ["aa", "bb", "cc"]


def test_fingerprints(spark, docs, odd):
    for d in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        known = texts(d)
        order = sorted(known, reverse=True)
        got = {r.doc_id: r for r in chunks.edit_likeness(d).collect()}
        assert sorted(got) == sorted(known)
        for a, b in zip(order, order[1:] + order[:1]):
            t, n = known[a] or "", known[b] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            assert got[a].n_chars == len(t) and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[a].fingerprint == chunks.encode(chunks.fingerprint(t.encode()))
            assert 0 <= got[a].near_edited <= 1
            if len(t) > 3000:
                assert got[a].near_edited > 0.3
    assert chunks.edit_likeness(docs.limit(0)).count() == 0
    assert chunks.edit_likeness(docs.limit(1)).first().near_next == 1.0
    data = (known_long := "".join(random.Random(1).choices("abcdefgh ", k=20000))).encode()
    assert chunks.containment(chunks.fingerprint(data), chunks.fingerprint(b"new words in front " + data)) > 0.97, known_long[:20]


def brute_fingerprint(data, low=40, mid=128, high=512):
    """Chunks by a hash of the last 32 bytes, computed anew at each place."""
    gear = [int(g) for g in chunks.gear_table()]
    ends, at = [], 0
    while at < len(data):
        end = min(len(data), at + high)
        if len(data) - at > low:
            for e in range(at + low, end):
                h = sum(gear[data[e - 1 - k]] << k for k in range(min(32, e))) & 0xFFFFFFFF
                if h >> (32 - (9 if e <= at + mid else 5)) == 0:
                    end = e
                    break
        else:
            end = len(data)
        ends.append((at, end))
        at = end
    return {data[a:b] for a, b in ends}


def test_fingerprint_is_brute_force():
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh \n", k=n)).encode() for n in (0, 1, 39, 40, 41, 700, 5000)]
    texts += [texts[-1][:2500] + b"new" + texts[-1][2500:], b"a" * 3000]
    sets = [brute_fingerprint(t) for t in texts]
    for t, s in zip(texts, sets):
        assert sorted(chunks.fingerprint(t)["length"].tolist()) == sorted(map(len, s))
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            small = min(sum(map(len, x)), sum(map(len, y)))
            want = sum(map(len, x & y)) / small if small else float(not x and not y)
            assert abs(chunks.containment(chunks.fingerprint(a), chunks.fingerprint(b)) - want) < 1e-12


def test_followers_of_odd_ids(spark):
    known = [(i, f"text {i} " * 30) for i in range(0, 4000, 2)] + [(1 << 60, "x"), (-(1 << 63), "low"), ((1 << 63) - 1, "high"), (None, "n1"), (None, "n2"), (8, "again"), (8, "again")]
    d = spark.createDataFrame(known, "doc_id long, text string").withColumn("PART", F.lit(1))
    for parts in (2, 8, 9):
        sizes = chunks.with_next(d, parts).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("part").alias("k")).collect()
        assert len(sizes) == parts and max(r.n for r in sizes) < 1.1 * len(known) / parts and all(r.k == 1 for r in sizes)
    order = sorted(known, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[(i, hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in chunks.edit_likeness(d).collect()) == want
    both = chunks.fingerprints(d.where("doc_id = 8 or doc_id is null").withColumn("fingerprint", F.lit(1)))
    assert all(r.fingerprint == chunks.encode(chunks.fingerprint(r.text.encode())) for r in both.collect())
    same = both.select(chunks.likeness(F.col("fingerprint"), F.col("fingerprint")).alias("x"), chunks.likeness(F.col("fingerprint"), F.lit(None).cast("string")).alias("y")).first()
    assert same.x == 1.0 and same.y is None


def test_chat(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [\\\\/INST] \\[/INST]<"), (-8, None, None, None), (-8, 1, "assistant", None), (-8, 1, "assistant", None), (-9, 0, "assistant", "first"), (-9, 1, "us[/INST]er", "last"), (None, 0, "user", "[")], "conv_id long, turn long, role string, text string")
    both = turns.union(odd)
    by = defaultdict(list)
    for r in both.collect():
        by[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    examples = chat.expand(both)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    full = defaultdict(list)
    for r in chat.full_texts(examples).collect():
        full[r.conv_id].append(r)
    assert set(got) == set(by)
    for conv, said in by.items():
        said.sort()
        replies = [t for _, role, t in said if role == "assistant"]
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert got[conv].loss_chars == sum(map(len, replies)) and got[conv].loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in sorted(full[conv], key=lambda r: r.example)] == replies


def test_chat_written_out(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok"), (-7, 1, "assistant", "[INST]assistant[/INST]"), (-7, 2, "assistant", ""), (-7, 3, "user", "last"), (None, 0, "user", "[")], turns.schema)
    both = turns.union(odd)
    full, folded = chat.written_out(both), chat.expand(both)
    real = Counter((r.conv_id, r.example, r.text, r.loss_start, r.loss_end) for r in full.where("loss_start is not null").collect())
    assert real == Counter(tuple(r) for r in chat.full_texts(folded).collect())
    chars = Counter()
    for r in full.collect():
        chars[r.conv_id] += len(r.text)
    got, want = {r.conv_id: r for r in chat.read_written(full).collect()}, {r.conv_id: r for r in chat.read_back(folded).collect()}
    assert {k: r[:5] for k, r in got.items()} == {k: r[:5] for k, r in want.items()} and {k: r.formatted_chars for k, r in got.items()} == chars
    written = {r.conv_id: r for r in queries.op6_chat(spark, SF).collect()}
    assert all(written[k].formatted_chars == n for k, n in chars.items() if k is not None and k >= 0)
    wrong = full.where("conv_id = -7").withColumn("text", F.when(F.col("example") == 0, F.replace("text", F.lit("ok"), F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="context is not the text"):
        chat.read_written(wrong).collect()


def test_chat_long_conversation(spark):
    """A conversation with most of the rows is divided: ranges of few replies say what whole ones say, and no task writes most of it."""
    r = random.Random(8)
    said = [(1, k, r.choice(["user", "assistant", "assistant", "tool"]), f"t{k} " + "[INST]" * (k % 3)) for k in range(600)]
    said += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "alone"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (1, 599, "user", "end")]
    turns = spark.createDataFrame(r.sample(said, len(said)), "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("_TO", F.lit(1)).repartition(5)
    want = {}
    for conv in (1, 2, 3, None):
        text, n = "", 0
        for _, _, role, t in sorted(x for x in said if x[0] == conv):
            text += f"[INST]{chat.escape(role)}[/INST]"
            if role == "assistant":
                want[conv, n] = (text + chat.escape(t) + "</s>", len(text), len(text) + len(chat.escape(t)))
                n += 1
            text += chat.escape(t) + "</s>"
    for replies in (3, 64, 5000):
        full = chat.written_out(turns, replies=replies)
        assert {(x.conv_id, x.example): (x.text, x.loss_start, x.loss_end) for x in full.where("loss_end is not null").collect()} == want
        assert {(x.conv_id, x.example): (x.text, x.loss_start, x.loss_end) for x in chat.full_texts(chat.expand(turns, replies=replies)).collect()} == want
        rest = full.where("loss_end is null").collect()
        assert {x.conv_id: x.text.endswith("[INST]user[/INST]" + t + "</s>") for x, t in ((x, "end" if x.conv_id == 1 else "alone") for x in rest)} == {1: True, 3: True}
    # so little would be put together into one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = chat.written_out(turns, replies=7).groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(x.n for x in spread) < 0.75 * sum(x.n for x in spread)
    empty = turns.where("turn < 0")
    assert chat.written_out(empty).count() == 0 and chat.read_back(chat.expand(empty)).count() == 0


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    for n, d in enumerate((docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"]))):
        known = texts(d)
        tokenfile.write_tokens(d, f"{tmp_path}/f{n}", WORD_BPE, segment=5000)
        got = {r.doc_id: r for r in tokenfile.read_tokens(spark, f"{tmp_path}/f{n}").collect()}
        at = 0
        for doc_id in sorted(known):
            ids = np.array([*t.encode(known[doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (got[doc_id].start, got[doc_id].n_tokens, zlib.crc32(got[doc_id].ids)) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    tokenfile.write_tokens(docs.limit(0), f"{tmp_path}/none", WORD_BPE)
    assert tokenfile.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_token_files_of_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    known = [(5, f"text number {i}") for i in range(300)] + [(None, "none"), (None, None), (7, "x y z"), (7, "x y z"), (-3, "long " * 9000)]
    d = spark.createDataFrame(known, "doc_id long, text string").withColumn("PART", F.lit("clash")).withColumn("ids", F.lit(1))
    tokenfile.write_tokens(d, f"{tmp_path}/r", WORD_BPE, segment=2000)
    got = sorted(tokenfile.read_tokens(spark, f"{tmp_path}/r").collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in known)
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_damaged_block_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 97
    s, f = tokenfile.frequency_table(ids)
    words, states, offsets, checks, steps = tokenfile.encode_blocks(ids, s, f)
    bad = np.frombuffer(words, np.uint32).copy()
    bad[10] ^= 4
    args = (np.frombuffer(states, np.uint64), np.frombuffer(offsets, np.uint64), checks, steps)
    assert (tokenfile.decode_blocks(5000, s, f, np.frombuffer(words, np.uint32), *args) == ids).all()
    with pytest.raises(ValueError):
        tokenfile.decode_blocks(5000, s, f, bad, *args)


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    for d in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        known = texts(d)
        sequences, by_doc = defaultdict(list), defaultdict(list)
        for r in packing.pack(d, WORD_BPE).collect():
            sequences[r.sequence_id].append(r)
            by_doc[r.doc_id].append(r)
        for doc_id, text in known.items():
            want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
            parts = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == want and all(r.doc_tokens == len(want) // 4 for r in parts)
        padded = total = 0
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and len(s) <= 256
            total += at
            padded += 0 if at & (at - 1) == 0 else 2048 - at
        assert padded <= 0.01 * total
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0


def test_packing_limits():
    p = packing.Packer(64, 3, 20, 16, 0)
    r = random.Random(2)
    for i in range(300):
        n = r.randrange(1, 100)
        p.add((i, 0, n, bytes(4 * n), n, n - n // 2, n // 2))
    p.finish()
    by = defaultdict(list)
    for x in p.out:
        by[x[6]].append(x)
    assert all(sum(x[2] for x in s) <= 64 and len(s) <= 3 and sum(x[5] for x in s) <= 20 for s in by.values())
    for limits in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            packing.Packer(*limits, 4, 0)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 0.95, 1.0])
def test_packing_under_a_loss_limit(share):
    """Sequences are hardly more than tokens or loss ask for."""
    p, r, tokens, loss = packing.Packer(2048, 256, 512, 256, 0), random.Random(3), 0, 0
    for i in range(300):
        n = r.randrange(1, 4300)
        masked = int(share * n)
        tokens, loss = tokens + n, loss + n - masked
        p.add((i, 0, n, bytes(4 * n), n, n - masked, masked))
    p.finish()
    by = defaultdict(list)
    for x in p.out:
        by[x[6]].append(x)
    assert all(sum(x[2] for x in s) <= 2048 and sum(x[5] for x in s) <= 512 for s in by.values())
    assert sum(x[2] for x in p.out) == tokens and sum(x[5] for x in p.out) == loss
    assert max(tokens / 2048, loss / 512) > 0.93 * (len(by) - 12)


def test_packing_of_masked_repeated_and_null_ids(spark):
    known = [(1, "one two three four", 2), (1, "one two three four", None), (None, "five six", 99), (2, None, -4), (3, "word " * 5000, 4000)]
    d = spark.createDataFrame(known, "doc_id long, text string, masked long").withColumn("LENGTH", F.lit("clash")).coalesce(1)
    got = packing.pack(d, WORD_BPE, max_loss=300, masked="masked").collect()
    tokens = lambda t: len((t or "").split()) + 1
    assert Counter({i: sum(r.length for r in got if r.doc_id == i) for i in {r.doc_id for r in got}}) == Counter({1: 10, None: 3, 2: 1, 3: 5001})
    assert sum(r.loss_tokens for r in got) == sum(tokens(t) - min(max(0, m or 0), tokens(t)) for _, t, m in known)


def plain_search(model, text):
    """The best segmentation of a text, all of it held."""
    best, back = [0.0] + [-math.inf] * len(text), [(0, -1)] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for a in range(max(0, end - model.longest), end):
            i = model.ids.get(text[a:end], -1)
            value = best[a] + (model.scores[text[a:end]] if i >= 0 else model.unknown_score)
            if (i >= 0 or end == a + 1) and value > best[end]:
                best[end], back[end] = value, (a, i)
    out, end = [], len(text)
    while end:
        a, i = back[end]
        out.append([i] if i >= 0 else [model.bytes[b] for b in text[a:end].encode()] if model.bytes else [model.unknown])
        end = a
    return [i for some in reversed(out) for i in some]


def test_pieces(spark, docs, odd, monkeypatch):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = pieces.PieceModel.of(path)
    data = open(path, "rb").read()
    # the same pieces and scores, read by the library as a unigram model: field 3 of the trainer's part is the kind
    trainer = data.rindex(b"\x18\x02\x20\x80\xfa\x01")
    unigram = sentencepiece.SentencePieceProcessor(model_proto=data[:trainer] + b"\x18\x01" + data[trainer + 2 :])
    for d in (docs, odd):
        for r in pieces.decode_pieces(pieces.encode_pieces(d, path), path).collect():
            assert r.decoded == r.text
            if r.text and len(r.text) < 5000:
                best = unigram.encode(r.text)
                score = lambda ids: sum(model.scores.get(model.text[i], 0.0) for i in ids)
                assert r.piece_ids == best or score(r.piece_ids) >= score(best) - 1e-6
    r = random.Random(6)
    parts = ["".join(r.choices("aeitnrs▁dlé'.,9日", k=r.randrange(0, 9 * model.longest))) for _ in range(2000)] + ["日本語x", "é\t\n", "▁", "", "a" * 3000, "▁" * 700 + "the" * 900, "e日" * 800]
    parts += sorted({w for t in list(texts(docs).values())[:40] for w in (t or "").split()})
    want = [plain_search(model, part) for part in parts]
    assert [np.frombuffer(ids, np.int32).tolist() for ids in model.search(parts)] == want
    # blocks of two windows each: paths are followed back and ids committed many times in a part
    monkeypatch.setattr(pieces, "CELLS", 1)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in model.search(parts)] == want
    assert np.frombuffer(model.search(parts[-1:] + ["the" * 4000])[1], np.int32).tolist() == plain_search(model, "the" * 4000)
    gaps = "a" + " " * 5000 + "b \t\n" * 2000
    assert model.decode(model.encode(gaps).tolist()) == gaps
    # spaces, marks and whole texts: cutting into parts loses no better segmentation
    odd_texts = ["a  b", "  ", " x   the  end ", "".join(r.choices("the  ea.,", k=400)), "▁ ▁a"]
    for text in odd_texts:
        assert model.encode(text).tolist() == plain_search(model, "▁" + text.replace(" ", "▁"))


def brute_counts(encoder, text, bounds, rule):
    """Tokens and crossing tokens of each section, -1 for none, character by character."""
    raw, at, out = text.encode(), 0, defaultdict(lambda: [0, 0])
    place = [k for k, c in enumerate(text) for _ in c.encode()]
    for i in encoder.encoding.encode_ordinary(text):
        size = int(encoder.sizes[i])
        own = sorted(set(place[at : at + size]))
        at += size
        holders = [next((k for k, (a, b) in enumerate(bounds) if a <= c < b), -1) for c in own]
        if rule == "start":
            owner = holders[0]
        elif rule == "end":
            owner = holders[-1]
        else:
            counts = Counter(h for h in holders if h >= 0)
            owner = min(counts, key=lambda h: (-counts[h], h)) if counts else -1
        out[owner][0] += 1
        out[owner][1] += owner >= 0 and any(h != owner for h in holders)
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, docs, odd, rule):
    ranks = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    e = tokencounts.SpanEncoder.of(ranks, queries.PATTERN)
    short = docs.where("length(text) < 1500").select("doc_id", "text")
    for d in (short, odd.withColumn("section", F.lit("clash")).withColumn("N_TOKENS", F.lit(0))):
        want = Counter()
        for doc_id, text in [(r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect()]:
            if len(text) > 3000:
                continue
            ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
            bounds = [(int(b - len(x) - 1), min(int(b), len(text))) for x, b in zip(text.split("\n"), ends)]
            found = brute_counts(e, text, bounds, rule)
            total = sum(n for n, _ in found.values())
            for k, (a, b) in enumerate(bounds):
                want[(doc_id, k, a, b, *found[k], total)] += 1
        got = Counter(tuple(r) for r in tokencounts.token_counts(d.where("text is null or length(text) <= 3000"), ranks, queries.PATTERN, rule=rule).collect())
        assert got == want
    assert tokencounts.token_counts(docs.limit(0), ranks, queries.PATTERN).count() == 0


def test_token_counts_of_given_sections(spark):
    ranks = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    e = tokencounts.SpanEncoder.of(ranks, queries.PATTERN)
    known = [(1, "one two three 日本語 four", [(0, 4), (8, 13)]), (2, "no sections at all", None), (3, "a gap, an empty one", [(2, 2), (7, 99), None]), (None, "  \t" * 400 + "x" * 2000, [(3, 9)]), (3, "", [(0, 0)])]
    d = spark.createDataFrame(known, "doc_id long, text string, s array<struct<start:int,end:int>>")
    want = Counter()
    for doc_id, text, given in known:
        bounds = sorted((min(a, len(text)), min(b, len(text))) for a, b in [g for g in given or [] if g])
        found = brute_counts(e, text, bounds, "majority")
        total = sum(n for n, _ in found.values())
        for k, (a, b) in enumerate(bounds):
            want[(doc_id, k, a, b, *found[k], total)] += 1
        if found[-1][0]:
            want[(doc_id, -1, 0, len(text), found[-1][0], 0, total)] += 1
    assert Counter(tuple(r) for r in tokencounts.token_counts(d, ranks, queries.PATTERN, sections="s").collect()) == want
    bad = spark.createDataFrame([(1, "one two", [(0, 4), (3, 5)])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="overlap"):
        tokencounts.token_counts(bad, ranks, queries.PATTERN, sections="s").collect()


def test_near_duplicates_of_null_and_repeated_ids(spark):
    words = lambda a, n=50: " ".join(f"w{i}" for i in range(a, a + n))
    known = [(4, words(0)), (9, words(0) + " more"), (9, words(500)), (7, words(500)), (None, words(0)), (None, None), (3, None), (3, ""), (8, words(900)), (8, words(900))]
    d = spark.createDataFrame(known, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("KEPT", F.lit(1))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(d, words=4).collect())
    assert got == Counter([(4, 47, 4, True), (9, 48, 4, False), (9, 47, 7, False), (7, 47, 7, True), (None, 47, None, True), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True), (8, 47, 8, True), (8, 47, 8, True)])


def test_columns_that_clash(spark):
    d = spark.createDataFrame([(1, "MIT license", 5), (None, None, None)], "doc_id long, text string, LABELS long").withColumn("n_words", F.lit("x")).withColumn("piece_ids", F.lit(1)).withColumn("Decoded", F.lit(2))
    got = licenses.license_scan(d)
    assert [c for c in got.columns if c.lower() == "labels"] == ["labels"] and sorted((r.doc_id or 0, r.n_words, r.labels) for r in got.collect()) == [(0, 0, ""), (1, 2, "mit")]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    back = pieces.decode_pieces(pieces.encode_pieces(d, path), path)
    assert {r.doc_id: r.decoded for r in back.select("doc_id", "decoded").collect()} == {1: "MIT license", None: None}
