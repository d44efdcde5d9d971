"""Quality classifier by co-training.

Two views describe a document: its text, and the page metadata (source, language, recorded length). A logistic model of each
view is fitted to labelled rows. Over some rounds each view labels the unlabelled rows it is sure of and hands them to the
other view; then both are calibrated on labelled rows kept apart, a logistic model of the two calibrated views is fitted
there, and it scores all documents.

Fitting takes bounded samples in the order of a hash of the id: at most `sample` labelled rows and as many unlabelled ones.
Scoring reads the whole text of every row.

Defined results: null and empty texts are scored by what is left of them (no words) and by their metadata; a null source,
language or length is a value of its own. Labels that are null or of unknown documents teach nothing; repeated labels of one
id are averaged. Without labels of both classes nothing can be learned: scores are null and every row is kept. Repeated rows
and ties are scored each for itself; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, filter_rows, fresh, map_texts

SAMPLE, ROUNDS, SURE, PER_ROUND, KEEP_FROM = 6000, 4, 0.97, 500, 0.5
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SOURCES, LANGS = 64, 16


def content_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size, words = max(len(raw), 1), raw.split()
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts / size
    used = shares[shares > 0]
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(len(words)), len(raw) / n, len(set(words)) / n, np.log(max(len(set(words)), 1)) / np.log(n + 1), sum(map(eq, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalnum, words)) / n, float(-(used * np.log(used)).sum()), len(lines) / n, len(set(lines)) / max(len(lines), 1),
        shares[65:91].sum(), shares[97:123].sum(), shares[48:58].sum(), shares[128:].sum(), shares[10], *np.sqrt(shares[list(MARKS)]),
    ]


def metadata_features(source: str | None, lang: str | None, length: float | None) -> list[float]:
    out = np.zeros(SOURCES + LANGS + 5)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    size = np.log1p(max(float(length or 0), 0.0))
    out[-5:] = source is None, lang is None, length is None, size, size * size / 10
    return out.tolist()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Ridge-penalised logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
        penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:]


@dataclass
class CoTrained:
    """Models of the two views, their calibrations, and the model that combines them."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated score of each view, and the combined one."""
        own = [c.margin(m.margin(x)[:, None]) for c, m, x in zip(self.calibrations, self.views, views)]
        return sigmoid(own[0]), sigmoid(own[1]), sigmoid(self.combined.margin(np.column_stack(own)))


def co_train(labelled: list[np.ndarray], y: np.ndarray, unlabelled: list[np.ndarray], rounds: int = ROUNDS, sure: float = SURE, per_round: int = PER_ROUND) -> CoTrained:
    """Every third labelled row is kept for calibration; `per_round` bounds what one view hands over in a round."""
    apart = np.arange(len(y)) % 3 == 2
    taught = [(x[~apart], y[~apart].astype(float)) for x in labelled]
    free = [np.ones(len(unlabelled[0]), bool) for _ in range(2)]  # rows that a view has not been given yet

    def fitted() -> tuple[list[Logistic], list[Logistic]]:
        views = [Logistic.fit(x, t) for x, t in taught]
        return views, [Logistic.fit(m.margin(x[apart])[:, None], y[apart]) for m, x in zip(views, labelled)]

    views, calibrations = fitted()
    for _ in range(rounds):
        handed = []
        for k in range(2):
            other = 1 - k
            p = sigmoid(calibrations[k].margin(views[k].margin(unlabelled[k])[:, None])) if len(unlabelled[k]) else np.zeros(0)
            certain = np.flatnonzero((np.maximum(p, 1 - p) >= sure) & free[other])
            # the classes go over in the proportion in which they were found
            certain = certain[np.argsort(-np.abs(p[certain] - 0.5), kind="stable")][:: max(1, -(-len(certain) // per_round))]
            handed.append((other, certain, (p[certain] > 0.5).astype(float)))
        for other, rows, labels in handed:
            free[other][rows] = False
            x, t = taught[other]
            taught[other] = np.vstack([x, unlabelled[other][rows]]), np.concatenate([t, labels])
        if not any(len(rows) for _, rows, _ in handed):
            break
        views, calibrations = fitted()
    margins = np.column_stack([c.margin(m.margin(x[apart])[:, None]) for c, m, x in zip(calibrations, views, labelled)])
    return CoTrained(views, calibrations, Logistic.fit(margins, y[apart]))


def both_views(batch: pa.RecordBatch, columns: dict[str, str]) -> list[np.ndarray]:
    value = lambda name: batch.column(columns[name]).to_pylist()
    meta = [metadata_features(*row) for row in zip(value("source"), value("lang"), value("n_chars"))]
    return [np.array([content_features(t) for t in value("text")]), np.array(meta)]


COLUMNS = {name: name for name in ("doc_id", "text", "source", "lang", "n_chars")}


def _narrow(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.select(*[F.col(c).cast(kinds[n]).alias(n) if n in kinds else F.col(c).alias(n) for n, c in columns.items()])


def train(docs: DataFrame, labels: DataFrame, columns: dict[str, str] = COLUMNS, label: str = "quality", sample: int = SAMPLE) -> CoTrained | None:
    """Fit on bounded samples; None unless both classes have three labelled documents."""
    inputs, known = _narrow(docs, columns), fresh("y")
    known_ids = labels.select("doc_id", F.col(label).cast("double").alias(known)).dropna().groupBy("doc_id").agg(F.avg(known).alias(known))
    ids = inputs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    taught = bounded_sample(known_ids.join(ids, "doc_id", "left_semi"), ["doc_id"], sample)
    others = bounded_sample(ids.join(known_ids, "doc_id", "left_anti"), ["doc_id"], sample)
    picked = taught.unionByName(others, allowMissingColumns=True)
    rows = inputs.join(F.broadcast(picked), "doc_id")  # at most 2 x sample narrow rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = both_views(batch, COLUMNS)
            packed = [pa.array([r.astype(np.float32).tobytes() for r in v], pa.binary()) for v in views]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column(known), *packed], ["doc_id", "y", "a", "b"])

    found = sorted(map(tuple, map_texts(rows, "text", work, "doc_id string, y double, a binary, b binary").limit(2 * sample).collect()), key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[2], r[3]))
    matrix = lambda chosen, i: np.array([np.frombuffer(r[i], np.float32) for r in chosen], float).reshape(len(chosen), -1)
    labelled, unlabelled = [r for r in found if r[1] is not None], [r for r in found if r[1] is None]
    y = np.array([r[1] >= 0.5 for r in labelled], float)
    if min(y.sum(), len(y) - y.sum()) < 3:
        return None
    by_class = sorted(range(len(y)), key=lambda i: y[i])  # so that each third has both classes
    labelled, y = [labelled[i] for i in by_class], y[by_class]
    return co_train([matrix(labelled, i) for i in (2, 3)], y, [matrix(unlabelled, i) for i in (2, 3)] if unlabelled else [np.zeros((0, matrix(labelled, i).shape[1])) for i in (2, 3)])


def score(docs: DataFrame, model: CoTrained | None, columns: dict[str, str] = COLUMNS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, content_score, metadata_score, score (probability of good quality), kept."""
    inputs = _narrow(docs, columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(both_views(batch, COLUMNS)) if model else [np.full(batch.num_rows, np.nan)] * 3
            kept = ~(found[2] < keep_from)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, from_pandas=True) for x in found], pa.array(kept)], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return map_texts(inputs, "text", work, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, content_score double, metadata_score double, score double, kept boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def good(docs: DataFrame, labels: DataFrame, columns: dict[str, str] = COLUMNS, keep_from: float = KEEP_FROM) -> DataFrame:
    """Rows that are kept, all columns as they were."""
    model = train(docs, labels, columns)

    def keep():
        def decide(batch: pa.RecordBatch) -> list[bool]:
            return (~(model.scores(both_views(batch, columns))[2] < keep_from)).tolist() if model else [True] * batch.num_rows

        return decide

    return filter_rows(docs, columns["text"], keep)
