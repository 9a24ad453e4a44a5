"""Fill-in-the-middle, importance resampling and exact duplicates against plain Python on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import middle, resample
from tilewright.llm.exact import exact_duplicates

LONG = "".join("x" * (i % 97) + ("é" if i % 5 else "日\r") + "\n" * (i % 3 > 0) for i in range(4000))
ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "no feed"), (5, "a\nb\n\nc"), (6, "\n\n\n"), (7, "x <P> y\nz"), (8, LONG), (9, LONG + "\n"), (10, "é" * 70000), (11, " a\x0bb\r\nc"),
    (12, "x\n" * 40000), (-13, "<M>"), (None, "no id\nat all\n"), (5, "a\nb\n\nc"), (2**62, "y\n" * 9),
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_middle(doc_id, text, rate=100, spm_rate=50, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_middle(spark, size):
    known = [x for x in ODD if size > 60 or len(x[1] or "") < 3000] + [(i, "line %d\n" % i * (i % 9) + "end" * (i % 2)) for i in range(100, 300)]
    d = spark.createDataFrame(known, "doc_id long, text string").withColumn("FORM", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("n_chars", F.lit("clash"))
    for rate, spm_rate in ((100, 50), (60, 0), (100, 100)):
        out = middle.fill_in_middle(middle.to_frames(d, size), rate=rate, spm_rate=spm_rate, size=size)
        want = Counter()
        for doc_id, text in known:
            *head, said = plain_middle(doc_id, text or "", rate, spm_rate)
            want[(doc_id, *head, sha(said), sha(text or ""))] += 1
        names = ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        assert Counter(tuple(r) for r in middle.digests(out).select(*names).collect()) == want
        assert {(r.doc_id, sha(r.output)) for r in middle.output_texts(out).select("doc_id", "output").collect()} == {(w[0], w[5]) for w in want}
    empty = middle.digests(middle.fill_in_middle(middle.to_frames(d.limit(0))))
    assert empty.count() == 0


def test_frames_are_seekable():
    codec = middle.Codec()
    r = random.Random(4)
    for size in (3, 10, 100):
        text = "".join(r.choice(["\n", "a", "é", "日本"]) for _ in range(400))
        data = text.encode()
        frames = [dict(zip(("units", "chars", "bytes", "data"), f)) for f in middle.frames_of(data, codec, size)]
        assert b"".join(codec.unpack(f["data"]) for f in frames) == data
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        opened = []
        codec.open = lambda x: opened.append(x) or codec.unpack(x)
        for k in range(len(units) + 1):
            opened.clear()
            f, at, chars = middle.unit_start(frames, k, len(units), codec)
            before = "".join(units[:k])
            assert (frames[f]["bytes"] + at if f < len(frames) else len(data)) == len(before.encode()) and len(opened) <= 1
            assert chars == (len(before) if k < len(units) else -1)
        del codec.open


def test_whole_frames_are_not_opened(monkeypatch):
    """Of a long text only the frames with a cut are decompressed for its example."""
    codec = middle.Codec()
    data = b"0123456789abcdef\n" * 5000
    frames = [dict(zip(("units", "chars", "bytes", "data"), f)) for f in middle.frames_of(data, codec, 1000)]
    opened = set()
    real = codec.unpack
    codec.unpack = lambda x: opened.add(x) or real(x)
    cuts = [middle.unit_start(frames, k, 5000, codec)[:2] for k in (1234, 4001)]
    out = middle.Output(codec, 1000)
    for a, b in (((0, 0), cuts[0]), (cuts[1], (len(frames), 0)), tuple(cuts)):
        out.add(b"<>")
        out.copy(frames, a, b)
    out.close()
    assert len(opened) <= 2 and len(frames) == 85
    assert b"".join(map(real, out.frames)) == b"<>" + data[: 17 * 1234] + b"<>" + data[17 * 4001 :] + b"<>" + data[17 * 1234 : 17 * 4001]


WORDS = [None, "", "...", "One", "one TWO three", "é naïve Ünder x", "a-b c_d 9x", " ".join(f"w{i % 7}" for i in range(60)), "the " * 5000, "x" * 50000, "ends with words \x00 nul", "one TWO three"]


def plain_resample(docs, target, ngrams, buckets, percent, min_words, seed=7):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    every = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in features(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sa + buckets) / ((s[b] + 1.0) * (ta + buckets))))
    rows = []
    for i, n, f in every:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    place = {r: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r, place.get(r)) for r in rows]


@pytest.mark.parametrize(("ngrams", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (1, 7, 100, 0), (3, 50, 60, 1)])
def test_resample(spark, ngrams, buckets, percent, least):
    r = random.Random(2)
    docs = [*enumerate(WORDS), *((100 + i, " ".join(r.choices(["sea", "Ship", "the", "wind", "ÉTÉ", "old"], k=r.randrange(0, 60)))) for i in range(300))]
    target = [None, "", "the old sea", "ship ship wind", "été"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("Weight", F.lit("clash")).withColumn("rank", F.lit(0))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(d, t, ngrams, buckets, percent, least).collect()
    assert sorted(tuple(x) for x in got) == sorted(plain_resample(docs, target, ngrams, buckets, percent, least))
    assert resample.resample(d.limit(0), t).count() == 0
    assert len(resample.resample(d, t.limit(0)).collect()) == len(docs)


def test_resample_null_and_repeated_ids(spark):
    docs = [(None, "one two three"), (None, "one two three"), (3, "one two three"), (3, "one two three"), (4, "four five")]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("one two",)], "text string"), percent=100, min_words=1).collect()
    assert sorted(x["rank"] for x in got) == [1, 2, 3, 4, 5] and len({x["score"] for x in got if x["doc_id"] == 3}) == 1


def plain_exact(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = min if keep == "smallest" else max
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        first = best(ids) if ids else None
        out.append((i, first, len(by[t or ""]), i == first, sha(t or "")))
    return Counter(out)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, keep, weak):
    """With a weak key most groups hold different texts, which are told apart by their bytes."""
    r = random.Random(8)
    rows = [*ODD, (None, None), (None, "only without id"), (None, "only without id"), (20, "A"), (21, "a"), (22, "a "), (23, "a"), (23, "a"), (24, "é"), (25, "é")]
    rows += [(1000 + i, f"copy {r.randrange(30)}") for i in range(400)] + [(5000 + i, "hot " * 50) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("KEPT", F.lit(3)).withColumn("h", F.lit("clash"))
    got = exact_duplicates(d, keep, key=(lambda t: F.length(t) % 5)) if weak else exact_duplicates(d, keep)
    assert Counter(tuple(x) for x in got.collect()) == plain_exact(rows, keep)
    assert exact_duplicates(d.limit(0), keep).count() == 0


def test_exact_after_normalising(spark):
    d = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None), (4, " ")], "doc_id long, text string")
    got = exact_duplicates(d, normalise=lambda t: F.trim(F.regexp_replace(F.lower(t), " +", " "))).collect()
    assert sorted((x.doc_id, x.keep_id, x.kept, x.text_sha256) for x in got) == [(1, 1, True, sha("a b")), (2, 1, False, sha("a b")), (3, 3, True, sha("")), (4, 3, False, sha(""))]
    with pytest.raises(ValueError, match="smallest"):
        exact_duplicates(d, "newest")


def test_exact_merges_copies_before_the_shuffle(spark):
    """A group of copies is one row a task, however large."""
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same " * 40)).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(d, "largest").where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (13_333, 19_999, 1)


def test_gains_of_large_counts():
    big = np.array([10**15, 0, 3], dtype=np.int64)
    assert resample.bucket_gains(big, np.zeros(3, np.int64)).tolist() == [math.floor(1000 * math.log((10.0**15 + 6) / ((10.0**15 + 1) * 3.0))), math.floor(1000 * math.log((10.0**15 + 6) / 3)), math.floor(1000 * math.log((10.0**15 + 6) / 12))]
