"""Quality rules: how far a document's histograms lie from those of known languages.

Scoring is a column expression over one row: no shuffle, no Python, no state. The references are learned from all labelled texts before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.staging import Staged, drop_staged, stage

SPACES = "[\\x20\\x09-\\x0D]+"
#: The character classes, each as a regular expression set; what is left is "other".
CHAR_CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": "\\x20\\x09-\\x0D", "punct": ".,;:!?()\\x22\\x27\\x2D", "beyond_ascii": "\\x{80}-\\x{10FFFF}"}
#: Tables of copied texts' hashes up to so many rows are broadcast.
FEW = 1_000_000
#: What counts as a common word: letters and their marks only.
LETTERS = "^[\\p{L}\\p{M}]+$"


def _bare(t: Column) -> Column:
    """``t`` without lower-case letters and blanks: they come in long runs, so there are few matches, and little is left."""
    return F.regexp_replace(t, f"[{CHAR_CLASSES['lower']} ]+", "")


def _blanks(t: Column) -> Column:
    """How many blanks ``t`` has; a fixed string is searched faster than a pattern, and lengths in bytes are known."""
    return F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))


def _class_counts(bare: Column, length: Column, blanks: Column) -> tuple[list[Column], Column]:
    """Characters of a text in each class, in order, then all others; and those others.

    What is neither a lower-case letter nor a blank is counted in ``_bare``, what is left without both; each class is counted in what those before it have left.
    """
    seen, left = {"lower": length - F.length(bare) - blanks}, bare
    for k in ("beyond_ascii", "punct", "upper", "digit", "space"):
        less = F.regexp_replace(left, f"[{CHAR_CLASSES[k]}]+", "")
        seen[k], left = F.length(left) - F.length(less), less
    seen["space"] = seen["space"] + blanks
    return [*[seen[k] for k in CHAR_CLASSES], F.length(left)], left


def learning_sample(docs: DataFrame, per_language: int = 2000, max_languages: int = 64, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``per_language`` distinct texts of each language with the lowest md5, or all if it has fewer: (l, t), staged; of the ``max_languages`` languages with the most rows (of equals, the first in order).

    Rows with a null lang or text are not learned from. Copies merge before anything is ranked; hashes alone are ranked, the lowest of each 64th, then of each
    eighth of a language's hashes first, so that no task ranks a whole language. Texts are fetched for the hashes drawn, at most ``per_language * max_languages``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    hashed = known.withColumn("h", F.md5(F.col("t").cast("binary")))
    counted = stage(hashed.groupBy("l", "h").agg(F.count("*").alias("n")), "counted")
    most = counted.groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").limit(max_languages).select("l")
    drawn = counted.join(F.broadcast(most), "l").select("l", "h").withColumn("fine", F.conv(F.substring("h", 31, 2), 16, 10).cast("int") % 64).withColumn("coarse", F.col("fine") % 8)
    for group in (["l", "fine"], ["l", "coarse"], ["l"]):
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).where(F.col("r") <= per_language)
    sample = stage(hashed.join(F.broadcast(drawn.select("l", "h")), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "t"), "sample")
    drop_staged(counted)
    return sample


def _spoken(texts: DataFrame) -> DataFrame:
    """(l, w, n, rows, chars) of texts (l, t, k), each counted k times: how often each word stands in them, and, with the first word of a text, how many texts and characters there are.

    Texts are cut at spaces, so the characters of a language's words and the spaces between them are all its characters. The empty word stands before and behind the spaces at a text's ends.
    """
    cut = texts.select("l", "k", F.length("t").cast("long").alias("size"), F.posexplode(F.split("t", SPACES)).alias("i", "w"))
    of_text = lambda c: F.sum(F.when(F.col("i") == 0, c).otherwise(F.lit(0).cast("long")))
    return cut.groupBy("l", "w").agg(F.sum("k").alias("n"), of_text(F.col("k")).alias("rows"), of_text(F.col("k") * F.col("size")).alias("chars"))


def _each_once(texts: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """One row (l, t) for each of the texts (l, t, h), which copies share h; where ``copied`` (l, h, more) is given, of its texts only, with ``more``. Copies merge before the shuffle."""
    if copied is None:
        return texts.groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "t")
    # as a join of two shuffled sides all texts would move
    copied = F.broadcast(copied) if copied.count() <= FEW else copied
    return texts.join(copied, ["l", "h"]).groupBy("l", "h", "more").agg(F.min("t").alias("t")).select("l", "t", "more")


def learn_references(
    docs: DataFrame,
    words: int = 10,
    max_languages: int = 64,
    min_words: int = 1000,
    max_char_distance: float = 0.25,
    min_chars: int = 200,
    per_language: int | None = None,
    text: str = "text",
    lang: str = "lang",
) -> dict:
    """Language references from all texts with a lang: ``{lang: {"chars": shares of the classes, then "other", "words": {word: share of all words}}}``.

    Every text counts, its copies in one language once. Class counts of each language are summed over all its texts
    first. Texts of ``min_chars`` characters or more that lie more than ``max_char_distance`` from their own language's sum are no prose of it (tables, scrambled
    letters); the references are summed over all others. The words are the ``words`` commonest ones that consist of letters (of equals, the first in
    order). A language with fewer than ``min_words`` words has no reference, and of more than ``max_languages`` those with the most rows are learned (of equals, the first in order).
    With ``per_language`` only the texts of ``learning_sample`` are learned from.

    All rows are counted in one pass by their words, and classes are counted in each different word; what copies and texts far from their language added is then taken off
    again, so that only those texts are shuffled. Counts are whole numbers, so nothing is lost by that. Only (classes + words) numbers for each language come to the driver. No labelled row gives {}.
    """
    spark = docs.sparkSession
    with Staged() as staged:
        if per_language is None:
            known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
        else:
            known = learning_sample(docs, per_language, max_languages, text, lang)
            staged.tables.append(known)
        one = F.lit(1).cast("long")
        hashed = known.withColumn("h", F.md5(F.col("t").cast("binary")))
        spoken = staged(_spoken(known.withColumn("k", one)), "spoken")
        copied = staged(hashed.groupBy("l", "h").agg((F.count("*") - 1).alias("more")).where("more > 0"), "copied")
        # rows are those of the whole table, copies included; they only choose the languages
        repeats = staged(_spoken(_each_once(hashed, copied).select("l", "t", (-F.col("more")).alias("k"))).withColumn("rows", F.lit(0).cast("long")), "repeats")

        counts = [F.col("n") * c for c in _class_counts(_bare(F.col("w")), F.length("w"), F.lit(0))[0]]
        counts[list(CHAR_CLASSES).index("space")] = F.col("chars") - F.col("n") * F.length("w")
        sums = F.array(*[F.sum(c).cast("double") for c in counts])
        total = spoken.unionByName(repeats).groupBy("l", "w").agg(*[F.sum(c).alias(c) for c in ("n", "rows", "chars")])
        whole = total.groupBy("l").agg(F.sum("rows").alias("rows"), sums.alias("s")).orderBy(F.desc("rows"), "l").limit(max_languages).collect()
        if not whole:
            return {}
        first = F.broadcast(spark.createDataFrame([(r["l"], [x / (sum(r["s"]) or 1.0) for x in r["s"]]) for r in whole], "l string, q array<double>"))
        made = F.array(*[c.cast("double") for c in _class_counts(_bare(F.col("t")), F.length("t"), _blanks(F.col("t")))[0]])
        # behind a generator: a lambda or a filter that got the counts as expressions would make them anew for each use
        counted = known.where(F.length("t") >= min_chars).select("l", "t", made.alias("c")).select("l", "t", F.explode(F.array("c")).alias("c"))
        sized = counted.join(first, "l")
        away = _js_distance(F.col("c"), F.aggregate("c", F.lit(0.0), lambda x, y: x + y), F.col("q"))
        far = sized.where(away > max_char_distance).select("l", "t", F.md5(F.col("t").cast("binary")).alias("h"))
        strange = staged(_spoken(_each_once(far).withColumn("k", -one)), "strange")

        prose = spoken.unionByName(repeats).unionByName(strange).join(first.select("l"), "l").groupBy("l", "w").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
        prose = staged(prose, "prose")
        said = prose.groupBy("l").agg(F.sum(F.when(F.col("w") != "", F.col("n"))).alias("all"), sums.alias("s"))
        found = {r["l"]: {"all": r["all"], "s": r["s"]} for r in said.orderBy("l").collect() if r["all"] and r["all"] >= min_words}
        place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))
        top = prose.where((F.col("n") > 0) & F.col("w").rlike(LETTERS)).withColumn("r", place).where(F.col("r") <= words).orderBy("l", "r").collect()
    return {
        k: {"chars": [x / sum(v["s"]) for x in v["s"]], "words": {r["w"]: r["n"] / v["all"] for r in top if r["l"] == k}}
        for k, v in found.items()
    }


def common_words(references: dict) -> list[str]:
    """The words of all references, each once, in order."""
    return sorted({w for r in references.values() for w in r["words"]})


def word_shares(reference: dict, vocabulary: list[str]) -> list[float]:
    """Shares over ``vocabulary``, then the share of all other words."""
    shares = [float(reference["words"].get(w, 0.0)) for w in vocabulary]
    return [*shares, 1.0 - sum(shares)]


def _shares(reference: list[float]) -> Column:
    base = sum(reference)
    return F.expr("array(" + ", ".join(f"{float(x) / base!r}D" for x in reference) + ")")


def _js_distance(counts: Column, total: Column, q: Column, elsewhere: Column | None = None) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; 0 alike, 1 disjoint. ``elsewhere`` are counts where ``q`` has nothing; each adds its whole share."""

    def term(n: Column, r: Column) -> Column:
        p = n / total
        m = (p + r) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(r > 0, r * F.log2(r / m)).otherwise(0.0)

    start = F.lit(0.0) if elsewhere is None else elsewhere / total
    divergence = F.aggregate(F.zip_with(counts, q, term), start, lambda a, x: a + x) / 2
    return F.sqrt(F.greatest(F.lit(0.0), divergence))


def distance_without_words(shares: list[float]) -> float:
    """How far a text that has none of the common words is from a language with these ``word_shares``."""
    other = shares[-1] / sum(shares)
    if other <= 0:
        return 1.0
    return math.sqrt(max(0.0, (1 - other + math.log2(2 / (1 + other)) + other * math.log2(2 * other / (1 + other))) / 2))


def quality(
    docs: DataFrame,
    references: dict | None = None,
    max_char_distance: float = 0.25,
    max_word_distance: float = 0.15,
    word_noise: float = 1.05,
    max_sum: float = 0.45,
    min_chars: int = 200,
    min_words: int = 40,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Add counts, distances and a verdict to every document.

    ``references`` are those of ``learn_references``; where none are given they are learned from the rows of ``docs`` that have
    a ``lang`` (jobs of their own). Without any labelled row there is nothing to compare with: distances are null and the base rules alone judge.

    Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Added columns: ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long), ``base_failed``, ``char_distance``,
    ``word_distance`` (double: least Jensen-Shannon distance to a language, six places; null when
    the text is shorter than ``min_chars`` characters or ``min_words`` words, which then says
    nothing against it) and ``kept``. A document is kept if the base rules hold and one
    language is near enough in each histogram and in the sum of both distances. The limit for words is
    ``max_word_distance`` plus ``word_noise`` over the root of the number of words, since few words scatter more, but always
    below the distance of a text that has none of the common words: such a text is rejected. Where a language's own distance to such a text is
    within ``max_word_distance`` (it is written without spaces, say) its words say nothing, and its characters decide. Common
    words are counted as they are written, so shouted text has few of them.

    A null text counts as empty: no words, ``base_failed``. An added name that the input already
    has is replaced. Each row stands alone, so ties, repeats and empty tables need no rule. The
    five-word windows are compared by hash first and by their words where hashes agree.
    """
    if references is None:
        references = learn_references(docs, text=text, lang=lang) if lang in docs.columns else {}
    vocabulary = common_words(references)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    keep = [c for c in docs.columns if c.lower() not in added]
    tmp = "__q_"

    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias(tmp + "t"))
    a = a.select("*", F.array_remove(F.split(F.col(tmp + "t"), SPACES), "").alias(tmp + "w"))
    w, t = F.col(tmp + "w"), F.col(tmp + "t")
    n = F.size(w)

    def of(name: str) -> Column:
        return F.col(tmp + name)

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # one character for each common word, three bytes long, in the order of the words
    codes = {v: chr(0x4E00 + i) for i, v in enumerate(vocabulary)}
    code_of = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    hits = F.array_join(F.transform(F.filter(w, lambda x: x.isin(vocabulary)), lambda x: F.element_at(code_of, x)), "") if vocabulary else F.lit("")
    a = a.select(
        "*",
        n.cast("long").alias(tmp + "n"),
        F.when(F.instr(t, "\n") > 0, lines).otherwise(F.array().cast("array<string>")).alias(tmp + "lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias(tmp + "h1"),
        hits.alias(tmp + "hits"),
        F.length(t).alias(tmp + "length"),
        _blanks(t).alias(tmp + "blanks"),
        _bare(t).alias(tmp + "rest"),
    )
    counts, others = _class_counts(of("rest"), of("length"), of("blanks"))
    # the symbols are all among the others
    symbols = F.length(others) - F.length(F.regexp_replace(others, "[#*$%&|<>]+", ""))
    a = a.select("*", F.array(*[x.cast("double") for x in counts]).alias(tmp + "cc"), symbols.cast("long").alias(tmp + "symbols"))

    # equal windows of five words begin with equal three words, and few texts repeat three words: only those look at their windows
    h1 = of("h1")
    three = F.transform(h1, lambda x, i: F.xxhash64(x, F.get(h1, i + 1), F.get(h1, i + 2)))
    a = a.withColumn(tmp + "h3", three)
    again = (F.size(of("h1")) > 5) & (F.size(F.array_distinct(of("h3"))) < F.size(of("h3")))
    h3 = of("h3")
    five = F.transform(F.slice(h3, 1, F.size(h3) - 4), lambda x, i: F.xxhash64(x, F.get(h3, i + 2)))
    a = a.withColumn(tmp + "h", F.when(again, five))
    # numbers sort faster than pairs: half of each hash beside its place; only places that share a half with another are looked at whole
    halves = F.transform(of("h"), lambda x, i: x.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long")))
    a = a.withColumn(tmp + "halves", F.sort_array(halves))
    halves = of("halves")

    def beside(x: Column, j: Column) -> Column:
        return F.shiftright(x, 32) == F.shiftright(F.get(halves, j), 32)

    shared = F.filter(halves, lambda x, j: beside(x, j + 1) | beside(x, j - 1))
    places = F.transform(shared, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    a = a.withColumn(tmp + "win", F.sort_array(F.transform(places, lambda i: F.struct(F.get(of("h"), i).alias("h"), i.alias("i")))))
    win = of("win")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False)) & (F.slice(w, x["i"] + 1, 5) == F.slice(w, y["i"] + 1, 5))

    def twin(j: Column) -> Column:
        return same(F.get(win, j), F.get(win, j - 1)) | same(F.get(win, j), F.get(win, j + 1))

    found = F.transform(F.filter(F.sequence(F.lit(0), F.size(win) - 1), twin), lambda j: F.get(win, j)["i"])
    a = a.withColumn(tmp + "found", F.when(F.size(win) > 0, F.sort_array(found)))
    found = of("found")
    steps = F.transform(found, lambda x, j: F.when(j == 0, 5).otherwise(F.least(F.lit(5), x - F.get(found, j - 1))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")

    per_word = [(F.octet_length(of("hits")) - F.octet_length(F.replace(of("hits"), F.lit(c), F.lit("")))) / 3 for c in codes.values()]
    a = a.select(
        *[F.col(f"`{c}`") for c in keep],
        of("n").alias("n_words"),
        (of("length") - F.get(of("cc"), list(CHAR_CLASSES).index("space"))).cast("long").alias("word_chars"),
        of("symbols").alias("n_symbols"),
        (F.size(of("lines")) - F.size(F.array_distinct(of("lines")))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        of("length").alias(tmp + "length"),
        of("cc"),
        F.array(*[x.cast("double") for x in per_word]).cast("array<double>").alias(tmp + "wc"),
        (F.octet_length(of("hits")) / 3).alias(tmp + "common"),
    )
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    long_chars, long_words = of("length") >= min_chars, F.col("n_words") >= min_words
    names = sorted(references)
    shares = [word_shares(references[k], vocabulary) for k in names]
    none = F.array().cast("array<double>")
    char_distances = [_js_distance(of("cc"), of("length").cast("double"), _shares(references[k]["chars"])) for k in names]

    def word_distance(r: list[float]) -> Column:
        # common words of other languages alone add their share as it is
        own = [i for i, x in enumerate(r[:-1]) if x > 0]
        said = [F.get(of("wc"), i) for i in own]
        elsewhere = of("common") - sum(said, F.lit(0.0))
        return _js_distance(F.array(*said, F.col("n_words") - of("common")), F.col("n_words").cast("double"), _shares([*[r[i] for i in own], r[-1]]), elsewhere)

    word_distances = [word_distance(r) for r in shares]
    # a guard turns a distance into null before it is computed
    a = a.select(
        "*",
        F.when(long_chars, F.array(*char_distances) if names else none).alias(tmp + "cd"),
        F.when(long_words, F.array(*word_distances) if names else none).alias(tmp + "wd"),
    )
    without = [distance_without_words(r) for r in shares]
    farthest = min((x for x in without if x > max_word_distance), default=1.0)
    word_limit = F.least(F.lit(0.99 * farthest), max_word_distance + word_noise / F.sqrt(F.col("n_words")))
    verdict = F.lit(not names)
    for i, own in enumerate(without):
        c, d = F.get(of("cd"), i), F.get(of("wd"), i)
        near = F.coalesce(c <= max_char_distance, F.lit(True))
        if own > max_word_distance:
            near = near & F.coalesce(d <= word_limit, F.lit(True)) & F.coalesce(c + d <= max_sum, F.lit(True))
        verdict = verdict | near
    made = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        F.round(F.array_min(of("cd")), 6).alias("char_distance"),
        F.round(F.array_min(of("wd")), 6).alias("word_distance"),
        (~base_failed & verdict).alias("kept"),
    )
    return behind_generate(a, keep, made, added)


def behind_generate(df: DataFrame, keep: list[str], made: Column, names: list[str]) -> DataFrame:
    """The kept columns and the fields of ``made``, computed once for each row.

    A later filter on a field would otherwise be pushed down through every step that it is built from, and
    repeat their expressions many times over; it stops at the generator.
    """
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(made)).alias("_made"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"_made.{n}").alias(n) for n in names])
