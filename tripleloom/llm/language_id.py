"""Language identification by string kernels.

The blended-spectrum presence kernel counts the byte 1-, 2- and 3-grams that two lower-cased texts share, whatever their
number in each, over the root of the product of their set sizes. Some documents of each language are landmarks; Nyström
features of all texts against them feed a one-versus-rest kernel ridge regression. Only grams that occur in a landmark can
count, so a batch of texts is a 0/1 matrix over these grams and its scores are two matrix products.

Learning takes a bounded sample (`sample` rows, `landmarks` of them as landmarks, even over the languages, in the order of
a hash of the id); prediction reads the whole text of every row and nothing else.

Defined results: a null text and one without letters is `und` with score 0, so is every text if nothing can be learned (no
labelled rows, empty table). Rows with a null id, language or text teach nothing. Equal texts get equal results; among equal
scores the language first in alphabetical order wins. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filter_rows, fresh, hash_share, is_fold, map_texts

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters count as a blank.
BLANKED = bytes(i if i >= 128 or bytes([i]).isalpha() else 32 for i in range(256))
N3, N2 = 1 << 24, 1 << 16
CODES = N3 + N2 + 256
#: A text whose share of known grams is below this part of the median of labelled texts is in none of their languages.
FAMILIAR = 0.85


def grams(text: str) -> np.ndarray:
    """Codes of all byte 1-, 2- and 3-grams of a text between blanks, repeats included."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(BLANKED), np.uint8).astype(np.int32)
    two = (data[:-1] << 8) | data[1:]
    return np.concatenate([(two[:-1] << 8) | data[2:], two + N3, data + (N3 + N2)])


@dataclass
class Model:
    """Grams of the landmarks, 0/1 matrix grams x landmarks, set sizes of the landmarks, and dual weights landmarks x languages.

    `familiar` is the share of its grams that a text of the languages has among these grams at least.
    """

    langs: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    familiar: float = 0.0

    def slots(self) -> np.ndarray:
        """Column of each gram code; 0 for grams of no landmark."""
        table = np.zeros(CODES, np.int32)
        table[self.codes] = np.arange(1, len(self.codes) + 1)
        return table

    def presence(self, gram_sets: list[np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """0/1 rows over the landmarks' grams, and the size of each whole set. The sets hold each gram once."""
        out = np.zeros((len(gram_sets), len(self.codes) + 1), np.float32)
        for i, codes in enumerate(gram_sets):
            out[i, slots[codes]] = 1
        return out[:, 1:], np.array([max(1, len(g)) for g in gram_sets], np.float32)

    def kernel(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (presence @ self.landmarks) / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def scores(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.kernel(presence, sizes) @ self.weights


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, landmarks: int = 96, ridge: float = 1e-2) -> Model | None:
    """Fit on at most `sample` rows of `docs`; None if no row has an id, a language and a text with letters."""
    rank, share, gram_column = fresh("rank"), fresh("share"), fresh("grams")
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).dropna()
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(landmarks)  # as many languages as can have a landmark
    each = -(-sample // max(1, sizes.count()))
    few = keys.withColumn(share, hash_share("doc_id")).join(F.broadcast(sizes), "lang").where(F.col(share) * F.col("n") < 3 * each)
    ranked = few.withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(share, "doc_id"))).where(F.col(rank) <= each)
    picked = ranked.orderBy(rank, share, "doc_id", "lang").limit(sample).select("doc_id", "lang")
    # at most `sample` narrow rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(picked.distinct()), ["doc_id", "lang"], "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(grams(t)).tobytes() if t and LETTER.search(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("lang"), pa.array(sets, pa.binary())], ["doc_id", "lang", gram_column])

    found = map_texts(rows, "text", work, f"doc_id string, lang string, {gram_column} binary").where(F.col(gram_column).isNotNull())
    taught = sorted(map(tuple, found.limit(sample).collect()))
    if not taught:
        return None
    by_lang: dict[str, list[np.ndarray]] = {}
    for _, name, packed in taught:
        by_lang.setdefault(name, []).append(np.frombuffer(packed, np.int32))
    langs = sorted(by_lang)
    turns = [(i, name) for name in langs for i in range(len(by_lang[name]))]
    chosen = [by_lang[name][i] for i, name in sorted(turns)[:landmarks]]
    codes = np.unique(np.concatenate(chosen))
    model = Model(langs, codes, np.zeros((len(codes), len(chosen)), np.float32), np.zeros(len(chosen), np.float32), np.zeros((len(chosen), len(langs))))
    slots = model.slots()
    present, model.sizes = model.presence(chosen, slots)
    model.landmarks = np.ascontiguousarray(present.T)
    values, vectors = np.linalg.eigh(model.kernel(present, model.sizes).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))  # Nyström: K_mm^(-1/2)
    everything = [(k, g) for k, name in enumerate(langs) for g in by_lang[name]]
    gram_matrix, target = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(langs)))
    shares = []
    for start in range(0, len(everything), 256):
        part = everything[start : start + 256]
        present, sizes = model.presence([g for _, g in part], slots)
        shares += (present.sum(axis=1) / sizes).tolist()
        features = model.kernel(present, sizes) @ root
        truth = np.where(np.array([k for k, _ in part])[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
        gram_matrix += features.T @ features
        target += features.T @ truth
    model.weights = root @ np.linalg.solve(gram_matrix + ridge * len(everything) / len(chosen) * np.eye(len(gram_matrix)), target)
    model.familiar = FAMILIAR * float(np.median(shares))
    return model


def _predicted(model: Model | None, slots: np.ndarray | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and share of known grams of each text, by batched matrix products."""
    names, scores, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
    for start in range(0, len(rows), 128):
        part = rows[start : start + 128]
        present, sizes = model.presence([np.unique(grams(texts[i])) for i in part], slots)
        found = model.scores(present, sizes)
        known[part] = present.sum(axis=1) / sizes
        for i, b, s in zip(part, found.argmax(axis=1), found.max(axis=1)):
            names[i], scores[i] = model.langs[b], min(1.0, max(0.0, (1 + s) / 2))
    return names, scores, known


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for the whole text of every row."""
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' grams

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        slots = own.slots() if own else None
        for batch in batches:
            names, scores, _ = _predicted(own, slots, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_texts(inputs, "text", work, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Learn from all folds but one, predict every row: doc_id, held_out, lang_pred, score."""
    teaching = docs.where(~is_fold(F.col(doc_id), folds, held_out))
    found = predict(docs, train(teaching, doc_id, text, lang), doc_id, text)
    return found.select("doc_id", is_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows in one of the learned languages, all columns as they were; learns from all labelled rows of `docs`.

    Rows without a language, with a score below `least`, or with too small a share of known grams for any of the languages go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id, text, lang))

    def keep():
        model = shared.value
        slots = model.slots() if model else None

        def decide(batch: pa.RecordBatch) -> list[bool]:
            found = zip(*_predicted(model, slots, batch.column(text).to_pylist()))
            return [name != UNKNOWN and score >= least and known >= model.familiar for name, score, known in found]

        return decide

    return filter_rows(docs, text, keep)
