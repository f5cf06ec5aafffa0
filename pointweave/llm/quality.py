"""Quality rules: a logistic regression on hashed word and character n-grams, with calibrated probabilities.

A text's features are the shares of its character n-grams (3 to 5 code points), words and word pairs in hashed
buckets, each kind by itself; a pair of equal words is one feature whatever the word. The regression is fitted
with Spark's own solver on rows that `labels.quality` marks, its scores become probabilities by a curve fitted
on other rows (Platt's), and texts are scored in Arrow batches. Weights are fixed-point numbers, so sums are
exact and equal texts get equal scores in whatever batch they come.

A text is kept if it fails no rule of counts (MIN_WORDS, MOST_REPEATED) and is good with a probability of KEEP
or more. The fit sees SAMPLE rows of each label at most, by hash of the id, of texts of up to SAMPLE_CHARS
characters; rows whose crc32(doc_id) mod 5 is 0 are held out, those where it is 1 calibrate. Counts and scores
cover whole texts.

Results in special cases: a null or empty text has no words and fails; with no labelled rows, or of one label
only, the regression keeps all; labels that are null or neither 0 nor 1 are not used, nor are documents with
both; without rows to calibrate with, the fitted curve stays as it is; repeated rows give repeated results, an
empty table an empty one; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, keep, map_texts, slices, table, texts_of

#: Fixed by the contract: least words of a text, and the percentage of its words in repeated windows of WINDOW words at most.
MIN_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Bounds of the sample that is fitted on: rows of each label, and characters of a text.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
#: Probability of good quality from which a text is kept.
KEEP = 0.5
BUCKET_BITS, CHAR_GRAMS = 17, (3, 4, 5)
PENALTY, ROUNDS = 0.02, 60
POINT = 1 << 24
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20250411))
_ODD = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


class Block:
    """Texts as one array of code points, each followed by a line end, and their words."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.code = np.frombuffer("".join(x + "\n" for x in texts).encode("utf-32-le"), np.uint32)
        self.end = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64) - 1
        self.start = np.concatenate((np.zeros(1, np.int64), self.end[:-1] + 1))
        blank = (self.code == 32) | ((self.code >= 9) & (self.code <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.word_start, self.word_end = edge[::2], edge[1::2]
        self.first_word = np.searchsorted(self.word_start, self.start)
        self.last_word = np.searchsorted(self.word_start, self.end)
        wide = self.code.astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(wide + _ODD[0]) * _powers(_BASE, len(wide)), dtype=np.uint64)))
            self.word = _mixed((sums[self.word_end] - sums[self.word_start]) * _powers(_INVERSE, len(wide))[self.word_start] + (self.word_end - self.word_start).astype(np.uint64))

    def _per_text(self, marks: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of marks from first up to last, by text."""
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(marks, dtype=np.int64)))
        return sums[last] - sums[first]

    def counts(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
        sized = np.zeros(len(self.code), np.int64)
        sized[self.word_start] = self.word_end - self.word_start
        lines = [[x for x in text.split("\n") if x.strip(BLANKS)] for text in self.texts]
        return {
            "n_words": self.last_word - self.first_word,
            "word_chars": self._per_text(sized, self.start, self.end),
            "n_symbols": self._per_text(np.isin(self.code, [ord(c) for c in SYMBOLS]), self.start, self.end),
            "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
            "n_repeat_words": self._per_text(self._repeated(), self.first_word, self.last_word),
        }

    def _repeated(self) -> np.ndarray:
        """Whether a word is in a window of words that its text has twice or more."""
        n = len(self.word)
        covered = np.zeros(n, bool)
        if n < WINDOW:
            return covered
        text = np.repeat(np.arange(len(self.texts)), self.last_word - self.first_word)
        with np.errstate(over="ignore"):
            window = text[: n - WINDOW + 1].astype(np.uint64) * _ODD[1]
            for i in range(WINDOW):
                window = _mixed(window + self.word[i : n - WINDOW + 1 + i] * _ODD[2 + i])
        inside = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
        order = inside[np.argsort(window[inside], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        twice = np.concatenate((order[1:][same], order[:-1][same]))
        for i in range(WINDOW):
            covered[twice + i] = True
        return covered

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind of n-gram the bucket at each place, and each text's first and last place."""
        shift = np.uint64(64 - BUCKET_BITS)
        with np.errstate(over="ignore"):
            wide = self.code.astype(np.uint64)
            total = np.zeros(len(wide), np.uint64)
            for i in range(max(CHAR_GRAMS)):
                total[: max(len(wide) - i, 0)] += wide[i:] * _ODD[8 + i]
                if i + 1 in CHAR_GRAMS:
                    yield ((_mixed(total + np.uint64(i)) >> shift).astype(np.int32), self.start, np.maximum(self.start, self.end - i))
            yield ((self.word * _ODD[6]) >> shift).astype(np.int32), self.first_word, self.last_word
            left, right = self.word[:-1], self.word[1:]
            pair = np.where(left == right, np.uint64(7), left * _ODD[5] + right * _ODD[7])
            yield (_mixed(pair) >> shift).astype(np.int32), np.minimum(self.first_word, len(pair)), np.maximum(np.minimum(self.first_word, len(pair)), self.last_word - 1)


@dataclass(frozen=True, eq=False)
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    intercept: float = 0.0
    #: Of the curve that makes probabilities of scores.
    slope: float = 1.0
    shift: float = 0.0

    @property
    def fitted(self) -> bool:
        return len(self.weights) > 0

    def logits(self, block: Block) -> np.ndarray:
        out = np.full(len(block.texts), self.intercept)
        for bucket, first, last in block.grams():
            out += block._per_text(self.weights[bucket], first, last) / (np.maximum(last - first, 1) * float(POINT))
        return out

    def probabilities(self, block: Block) -> np.ndarray:
        if not self.fitted:
            return np.ones(len(block.texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(block) + self.shift, -40, 40)))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label, fold: a row for each labelled document of the sample that is not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").alias("label"), F.min("quality").alias("least")).where("label = least")
    short = texts_of(docs).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(SAMPLE).unionAll(known.where("label = 1").orderBy(*order).limit(SAMPLE)).select("doc_id", "label")
    # at most 2 * SAMPLE ids, a bound that holds at every size; repeated documents give their rows once
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return rows.withColumn("fold", fold())


def hashed(rows: DataFrame) -> DataFrame:
    """The features of each row as buckets and values."""

    def run(texts: list[str], rest: dict) -> dict:
        at, values = [], []
        for text in texts:
            found = [(b[f[0] : e[0]], e[0] - f[0]) for b, f, e in Block([text]).grams()]
            bucket, place = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
            at.append(bucket)
            values.append(np.bincount(place, np.concatenate([np.full(len(b), 1.0 / max(n, 1)) for b, n in found]), len(bucket)))
        return {"label": rest["label"].cast(pa.float64()), "fold": rest["fold"], "at": at, "value": values}

    return map_texts(rows.select("text", "label", "fold"), "text", run, "label double, fold long, at array<int>, value array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the regression on some of the sampled rows and its curve on the others."""
    vector = F.udf(lambda at, value: Vectors.sparse(1 << BUCKET_BITS, at, value), VectorUDT())
    rows = keep(hashed(sample(docs, labels)), "quality-rows")
    sides = {(r["calibrates"], r["label"]) for r in rows.select((F.col("fold") == 1).alias("calibrates"), "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= sides:
        return Model()
    fit = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=PENALTY, maxIter=ROUNDS, aggregationDepth=2)
    own, fewer = rows.where("fold <> 1"), rows.where("fold <> 1").groupBy("label").count()
    n = dict(fewer.collect())
    weighed = own.select("label", vector("at", "value").alias("features"), F.when(F.col("label") == 0, 0.5 / n[0.0]).otherwise(0.5 / n[1.0]).alias("weight"))
    fitted = fit.fit(weighed)
    model = Model(np.round(fitted.coefficients.toArray() * POINT).astype(np.int64), float(fitted.intercept))
    if not {(True, 0.0), (True, 1.0)} <= sides:
        return model
    weights = model.weights / POINT
    logit = F.udf(lambda at, value: float(np.dot(weights[at], value)) + model.intercept, "double")
    scored = rows.where("fold = 1").select("label", logit("at", "value").alias("score")).collect()
    slope, shift = _curve(np.array([r["score"] for r in scored]), np.array([r["label"] for r in scored]))
    return Model(model.weights, model.intercept, slope, shift)


def _curve(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's steps on the likelihood, with targets drawn in by the number of rows."""
    good, bad = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    z, w = np.stack((score, np.ones(len(score))), 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (target - p))
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def judged(texts: list[str], model: Model, most: int = BLOCK_BYTES) -> dict[str, np.ndarray]:
    """The counts, base_failed, the probability and kept of each text."""
    parts, at = [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        block = Block(texts[at:end])
        parts.append({**block.counts(), "probability": model.probabilities(block)})
        at = end
    out = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["probability"] >= KEEP)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counts, base_failed, probability of good quality, and kept, for each row."""

    def run(texts: list[str], rest: dict) -> dict:
        found = judged(texts, model)
        return {"doc_id": rest["doc_id"], **{name: found[name] for name in COLUMNS}}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return map_texts(texts_of(docs), "text", run, schema)


def of_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are kept; no row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(judged([x or "" for x in part.column("text").to_pylist()], model)["kept"]))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, table(spark, sf_dir, "labels")))
