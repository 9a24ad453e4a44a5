"""Language identification by a string kernel.

The kernel of two texts is the number of distinct 1-, 2- and 3-grams of code points (in lower case) that both hold (blended-spectrum
presence), normalised by the roots of their own counts of distinct n-grams; it is exact for any script. Nyström landmarks map a text to a few dozen kernel
values; one-versus-rest kernel ridge regression on those gives a score for every language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, slices, without

#: An n-gram is a whole number: 21 bits for each code point, plus 1, from the lowest bits on; so shorter n-grams come first.
BITS = 21
TRIGRAM = 1 << 2 * BITS


def gram_keys(text: str) -> list[np.ndarray]:
    """The 1-, 2- and 3-grams of a text in lower case, with repeats."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64) + 1
    b = a[:-1] | a[1:] << BITS
    return [a, b, b[:-1] | a[2:] << 2 * BITS]


def distinct_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, ascending; how often each occurs)."""
    keys = gram_keys(text)
    for k in keys:
        k.sort()
    every = np.concatenate(keys)
    new = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[new], np.diff(np.append(new, len(every)))


class KernelModel:
    """Landmark n-grams, their matrix, and the weights of the languages."""

    def __init__(self, languages: list[str], grams: np.ndarray, matrix: np.ndarray, norms: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages = languages
        self.grams, self.matrix, self.norms, self.weights, self.bias = grams, matrix, norms, weights, bias
        #: Per language its common 3-grams, and the least share of a text's 3-grams that must be among them.
        self.known: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in languages]
        self.limits = np.zeros(len(languages))
        self.table = None

    def open(self) -> KernelModel:
        """Make the table of all n-grams that matter, with their columns and languages; done where the model is used."""
        if self.table is None:
            table = np.unique(np.concatenate([self.grams, *self.known]))
            column = np.full(len(table), -1)
            column[np.searchsorted(table, self.grams)] = np.arange(len(self.grams))
            among = np.zeros((len(table), len(self.languages)), dtype=np.float32)
            for k, codes in enumerate(self.known):
                among[np.searchsorted(table, codes), k] = 1
            self.table = table, column, among
        return self

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of 0 and 1: which landmark n-grams each whole text holds; how many distinct n-grams it has at all; and its share of 3-grams common in each language (1 if it has none)."""
        table, column, among = self.table
        out = np.zeros((len(texts), len(self.grams)), dtype=np.float32)
        own, shares = np.ones((len(texts), 1)), np.ones((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            found, counts = distinct_grams(text)
            own[i] = max(1, len(found))
            three = counts[np.searchsorted(found, TRIGRAM) :].sum()
            if len(table):
                at = np.minimum(np.searchsorted(table, found), len(table) - 1)
                hit = table[at] == found
                at, counts, found = at[hit], counts[hit], found[hit]
                landmark = column[at]
                out[i, landmark[landmark >= 0]] = 1.0
            if three:
                first = np.searchsorted(found, TRIGRAM)
                shares[i] = (counts[first:] @ among[at[first:]] if len(table) else 0) / three
        return out, own, shares

    def _kernel(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (x @ self.matrix) / (np.sqrt(own) * self.norms)

    def kernel(self, texts: list[str]) -> np.ndarray:
        return self._kernel(*self.presence(texts)[:2])

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text, and its score: 0 where too few of the 3-grams are common in that language."""
        x, own, shares = self.presence(texts)
        s = self._kernel(x, own) @ self.weights + self.bias
        k, row = s.argmax(axis=1), np.arange(len(texts))
        return k, np.where(shares[row, k] >= self.limits[k], np.clip(s[row, k], 0.0, 1.0), 0.0)


def fit(texts: list[str], labels: list[str], landmarks: int = 24, ridge: float = 0.05) -> KernelModel:
    """A model from a bounded sample: the first ``landmarks`` texts of each language are landmarks."""
    languages = sorted(set(labels))
    seen: dict[str, int] = {}
    chosen = []
    for t, lang in zip(texts, labels, strict=True):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            chosen.append(t)
    per_text = [distinct_grams(t)[0] for t in chosen]
    grams = np.unique(np.concatenate(per_text)) if per_text else np.zeros(0, dtype=np.int64)
    matrix = np.zeros((len(grams), len(chosen)), dtype=np.float32)
    for k, g in enumerate(per_text):
        matrix[np.searchsorted(grams, g), k] = 1.0
    norms = np.sqrt(np.maximum(matrix.sum(axis=0), 1.0)).astype(np.float32)
    model = KernelModel(languages, grams, matrix, norms, np.zeros((len(chosen), len(languages)), np.float32), np.zeros(len(languages), np.float32)).open()
    if not languages:
        return model
    among = (matrix.T @ matrix) / (norms[:, None] * norms)
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([model.kernel(texts[i : i + 64]) for i in range(0, len(texts), 64)]).astype(np.float64)
    features = kernel @ to_features
    target = np.array([[float(lang == k) for k in languages] for lang in labels])
    mean_x, mean_y = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean_x
    solved = np.linalg.solve(centred.T @ centred + ridge * len(texts) * 1e-2 * np.eye(features.shape[1]), centred.T @ (target - mean_y))
    model.weights = (to_features @ solved).astype(np.float32)
    model.bias = (mean_y - mean_x @ solved).astype(np.float32)
    for k, lang in enumerate(languages):
        model.known[k], model.limits[k] = _common([t for t, of in zip(texts, labels, strict=True) if of == lang])
    model.table = None
    return model.open()


def _common(texts: list[str]) -> tuple[np.ndarray, float]:
    """The 3-grams that two texts or more hold, and three quarters of the share of them that all but 5 % of the texts reach.

    A text's share is taken over what two others hold, so a language with fewer than three texts has the limit 0.
    """
    each = [(f[np.searchsorted(f, TRIGRAM) :], n[np.searchsorted(f, TRIGRAM) :]) for f, n in map(distinct_grams, texts)]
    found, held = np.unique(np.concatenate([f for f, _ in each]), return_counts=True)
    shares = [n[held[np.searchsorted(found, f)] >= 3].sum() / n.sum() for f, n in each if len(f)]
    return found[held >= 2], 0.75 * float(np.quantile(shares, 0.05)) if shares else 0.0


def held_out(doc_id: str):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0 (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int, max_chars: int, max_languages: int = 64) -> DataFrame:
    """The ``per_language`` distinct learnable texts of each language with the lowest hashes, or all if it has fewer; of the ``max_languages`` languages with the most rows (of equals, the first in order).

    Rows with null lang or text, without a letter, or held out are not learned from. A text longer than ``max_chars`` is cut into even
    windows of at most so many characters, which are drawn like texts. Only hashes are ranked: copies merge before, and texts are
    fetched for the hashes drawn. The lowest of each 64th, then of each eighth of a language's hashes are found first, so that no task ranks a whole language.
    """
    able = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    most = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    able = able.join(F.broadcast(most), "lang")
    n = F.ceil(F.length("text") / max_chars)
    width = F.ceil(F.length("text") / n).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(F.col("text"), i * width + 1, width))
    long = F.length("text") > max_chars
    able = able.where(~long).unionByName(able.where(long).select("lang", F.explode(windows).alias("text")))
    able = able.where(F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    drawn = able.select("lang", "h").distinct().withColumn("fine", F.pmod("h", F.lit(64))).withColumn("coarse", F.pmod("h", F.lit(8)))
    for group in (["lang", "fine"], ["lang", "coarse"], ["lang"]):
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).where(F.col("r") <= per_language)
    return able.join(F.broadcast(drawn.drop("fine", "coarse")), ["lang", "h"]).groupBy("lang", "r").agg(F.min("text").alias("text")).select("lang", "text", "r")


def train(docs: DataFrame, per_language: int = 300, landmarks: int = 24, max_chars: int = 8000, max_languages: int = 64) -> KernelModel:
    """Fit on a bounded sample: at most ``per_language`` texts of ``max_chars`` characters for each of at most ``max_languages`` languages come to the driver."""
    rows = sorted((r["r"], r["lang"], r["text"]) for r in training_sample(docs, per_language, max_chars, max_languages).collect())
    return fit([r[2] for r in rows], [r[1] for r in rows], landmarks)


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from the whole text alone.

    A null text, one without a letter (Unicode category L), or a model that learned no language gives ``und`` and 0. Scores over the languages sum to 1, so one
    is always best; a text with too few 3-grams common in it, against the limit from the training sample, has the score 0: it is in no
    learned language. Ties go to the language first in
    order. An added name that the input already has is replaced. Texts are scored in batches of a few dozen by matrix
    products; rows stand alone, so repeats and empty tables need no rule.
    """
    keep = without(docs, ["lang_pred", "score"])
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = [c.lower() for c in keep].index(text.lower())
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(_closed(model))

    def run(batches):
        m = shared.value.open()
        for batch in slices(batches, 48):
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if m.languages else []
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                for i, k, v in zip(known, *m.best([texts[i] for i in known]), strict=True):
                    langs[i], scores[i] = m.languages[int(k)], round(float(v), 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow_schema(schema))

    return source.mapInArrow(run, schema)


def _closed(model: KernelModel) -> KernelModel:
    model.table = None
    return model
