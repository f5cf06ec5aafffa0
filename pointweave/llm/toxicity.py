"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Every window of a
text is compressed with each; what the toxic dictionary saves over the ordinary one is the window's
gain. A window is hot when its gain exceeds a threshold, and the document's hottest gain, hot gain
and hot share go through a logistic curve; threshold and curve are calibrated on labelled rows.

Both dictionaries are raw content: the segments of their own class, then the same background of
ordinary text. Segments are word stems that are far likelier in documents of the class. As all else
is shared, windows without such segments gain nothing, at any length of text. Segments and curve
are fitted on a bounded sample (SAMPLE rows of each label, by hash of the id, texts of up to
SAMPLE_CHARS characters); scoring covers every window of every text.

Results in special cases: a null or empty text has one empty window and scores as a text without
hot windows; with no labelled rows, or of one label only, there is nothing to tell apart and every
score is 0.0; labels that are null or neither 0 nor 1 are not used, and if a doc_id has both, the
toxic one counts; repeated rows give repeated results, an empty table an empty one; columns other
than those named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_texts, slices, table, texts_of

#: Bounds of the sample that the model is fitted on.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
WINDOW, STEP, LEVEL = 64, 48, 9
SEGMENT_BYTES, BACKGROUND_BYTES = 6 << 10, 8 << 10
#: A segment stands in this many, and this share, of the documents of its class at least, and is this much likelier there.
MIN_DOCS, MIN_SHARE, MIN_RATIO = 4, 0.02, 12.0
#: One of so many rows calibrates the curve; the others give the segments.
CALIBRATE = 3
STEM = range(4, 13)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: float = 0.0
    weights: tuple[float, ...] = ()

    @property
    def fitted(self) -> bool:
        return bool(self.weights)


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    given.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=given, compression_params=how)


def shown(text: str) -> bytes:
    """Words with a capital and small letters: the inside of a word then differs from the start of another."""
    return text.title().encode()


def windows(text: str) -> list[bytes]:
    """Overlapping windows of the shown text; every byte is in one, and every word of up to WINDOW - STEP bytes is whole in one."""
    raw = shown(text)
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)]


def gains(texts: Iterable[str], toxic: bytes, ordinary: bytes) -> list[np.ndarray]:
    """Bytes that the toxic dictionary saves, by window, for each text."""
    cut = [windows(x) for x in texts]
    flat = [w or b" " for ws in cut for w in ws]
    if not flat:
        return []
    sizes = [np.fromiter(map(len, _compressor(d).multi_compress_to_buffer(flat)), np.int32, len(flat)) for d in (ordinary, toxic)]
    return np.split(sizes[0] - sizes[1], np.cumsum([len(ws) for ws in cut])[:-1])


def features(gain: np.ndarray, threshold: float) -> np.ndarray:
    hot = gain[gain > threshold]
    return np.array([1.0, np.log1p(hot.max() if len(hot) else 0), np.log1p(hot.sum()), np.log1p(100 * len(hot) / len(gain))])


def _segments(own: Counter, n_own: int, other: Counter, n_other: int) -> bytes:
    """Words that hold the stems likelier in one class, the best last, so nearest to the text."""
    stems: dict[str, list[int]] = {}
    for side, words in enumerate((own, other)):
        for w, n in words.items():
            for k in STEM:
                if k <= len(w) and (side == 0 or w[:k] in stems):
                    stems.setdefault(w[:k], [0, 0])[side] += n
    least = max(MIN_DOCS, MIN_SHARE * n_own)
    ratio = {s: (a + 0.5) / (n_own + 1) / ((b + 0.5) / (n_other + 1)) for s, (a, b) in stems.items() if a >= least}
    ranked = sorted((s for s, r in ratio.items() if r >= MIN_RATIO), key=lambda s: (-min(stems[s][0], n_own) * np.log(ratio[s]), -len(s), s))
    full = {s: max((t for t in ranked if t.startswith(s) and stems[t][0] >= 0.9 * stems[s][0]), key=len) for s in ranked}
    chosen: list[str] = []
    for s in ranked:
        if not any(full[s].startswith(c) or c.startswith(s) for c in chosen) and sum(len(c.encode()) + 1 for c in chosen) < SEGMENT_BYTES:
            chosen.append(full[s])
    return b" ".join(shown(c) for c in reversed(chosen))


def unlike(texts: list[str]) -> list[str]:
    """One text of each group of copies and near copies: those that share one of four least hashes of word triples."""
    kept, seen = [], set()
    for x in texts:
        words = WORD.findall(x.lower())
        triples = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
        signs = {(k, min(zlib.crc32(t, k) for t in triples)) for k in range(4)}
        if not signs & seen:
            kept.append(x)
        seen |= signs
    return kept


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows: segments from some of them, threshold and curve from the others."""
    texts = [unlike([x or "" for x, y in rows if y == side]) for side in (0, 1)]
    learnt = [[x for i, x in enumerate(t) if i % CALIBRATE or len(t) < 2 * CALIBRATE] for t in texts]
    held = [[x for i, x in enumerate(t) if not i % CALIBRATE or len(t) < 2 * CALIBRATE] for t in texts]
    if not all(texts):
        return Model()
    found = [Counter(), Counter()]
    for side in (0, 1):
        for x in learnt[side]:
            found[side].update(set(WORD.findall(x.lower())))
    background = b" ".join(shown(x)[:512] for x in learnt[0][: BACKGROUND_BYTES // 256])[:BACKGROUND_BYTES]
    own = [_segments(found[side], len(learnt[side]), found[1 - side], len(learnt[1 - side])) for side in (0, 1)]
    toxic, ordinary = own[1] + b" " + background, own[0] + b" " + background
    y = np.array([0.0] * len(held[0]) + [1.0] * len(held[1]))
    gain = gains(held[0] + held[1], toxic, ordinary)
    best = None
    for threshold in range(1, 9):
        z = np.stack([features(g, threshold) for g in gain])
        w = _logistic(z, y)
        p = np.clip(1 / (1 + np.exp(-z @ w)), 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w)
    return Model(toxic, ordinary, float(best[1]), tuple(best[2].tolist()))


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(texts: list[str], model: Model) -> list[float]:
    if not model.fitted:
        return [0.0] * len(texts)
    w = np.array(model.weights)
    return [float(1 / (1 + np.exp(-np.clip(features(g, model.threshold) @ w, -30, 30)))) for g in gains(texts, model.toxic, model.ordinary)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    short = texts_of(docs).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(SAMPLE).unionAll(known.where("label = 1").orderBy(*order).limit(SAMPLE))
    # at most 2 * SAMPLE ids, a bound that holds at every size; repeated documents give their rows once
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    model = fit([(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])])
    give_back()  # the driver's memory of the sample
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for each row."""

    def run(texts: list[str], rest: dict) -> dict:
        scores = score(texts, model)
        return {"doc_id": rest["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_texts(texts_of(docs), "text", run, "doc_id long, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic; no row is moved."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield part.filter(pa.array([s < 0.5 for s in score(texts, model)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
