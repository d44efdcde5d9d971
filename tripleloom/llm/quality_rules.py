"""Quality rules: counted rules first, then the Jensen-Shannon distance of a document to language references.

Two histograms describe a text: classes of characters, and common words of the language with everything else in one
bin. The reference of a language is the mean histogram of all its documents of some length. A document is compared with
every reference and judged by the nearest, so a wrong language label rejects nothing. A document labelled with a language that has
no reference is not judged by divergence, as prose of a language nobody described is unlike all others.

Defined results: a null or empty text has no words and fails the counted rules; a null or undescribed language takes part
in no reference; with no reference at all (empty table, only short texts) nothing is rejected by divergence; repeated
rows and ties are judged alike, each by its own text; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Common words of each language, most frequent first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with be as this by at are from",
    "de": "der die und in den von zu das des mit sich für auf ist im nicht dem ein eine als",
    "fr": "de la le et les des en un du une que pour est dans qui au par sur pas avec",
    "es": "de la que el en y los se del un las por con para una no su es al lo",
}
SYMBOLS = b"#*$%&|<>"
CLASSES = 9
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 10, 5, 20
#: Distances (0 to 1) above which a document is unlike every reference, and the sizes from which they are asked for.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.33, 200
MAX_WORD_DISTANCE, MIN_WORDS_DIVERGENCE = 0.25, 50


def _class_table() -> np.ndarray:
    """Class of each byte: other control, space, lower, upper, digit, sentence mark, symbol, other mark, beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for i in range(256):
        c = bytes([i])
        if c in b" \t\n\r\x0b\x0c":
            table[i] = 1
        elif i >= 128:
            table[i] = 8
        elif c.islower():
            table[i] = 2
        elif c.isupper():
            table[i] = 3
        elif c.isdigit():
            table[i] = 4
        elif c in b".,;:'\"()-":
            table[i] = 5
        elif c in SYMBOLS:
            table[i] = 6
        elif 32 < i < 127:
            table[i] = 7
    return table


TABLE = _class_table()
LANGS = sorted(COMMON_WORDS)
#: A common word counts with or without a mark behind it.
WORD_FORMS = {lang: [[w.encode() + mark for mark in (b"", b",", b".")] for w in words.split()] for lang, words in COMMON_WORDS.items()}


def repeated_words(words: list[bytes], size: int = REPEAT_WORDS) -> int:
    """How many words stand in a window of `size` words that occurs twice or more, the first one included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.array([counts[w] > 1 for w in windows])
    covered = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(hit)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((covered[:-1].cumsum() > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def histograms(raw: bytes, words: list[bytes], langs: list[str] = LANGS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Character-class counts of a text and its common-word counts for each of the languages."""
    chars = np.bincount(TABLE[np.frombuffer(raw, np.uint8)], minlength=CLASSES).astype(float)
    plain = Counter(raw.lower().split())
    by_lang = {}
    for lang in langs:
        hist = np.array([sum(plain[v] for v in forms) for forms in WORD_FORMS[lang]] + [0.0])
        hist[-1] = len(words) - hist.sum()
        by_lang[lang] = hist
    return chars, by_lang


def counted(raw: bytes, words: list[bytes], chars: np.ndarray) -> list[int]:
    """Words, code points in words, symbols, duplicate lines, words in repeated windows."""
    continuation = int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum()) if chars[8] else 0
    return [len(words), len(raw) - continuation - int(chars[1]), int(chars[6]), duplicate_lines(raw), repeated_words(words)]


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0: equal, 1: disjoint) of each row of counts to q, less what chance adds at that length."""
    n = np.maximum(p.sum(axis=1, keepdims=True), 1.0)
    p, q = p / n, (q / q.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        other = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (own + other) / 2 - (p.shape[1] - 1) / (8 * np.log(2) * n[:, 0])))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean character and word histograms of each language over all its documents of MIN_WORDS_DIVERGENCE words or more.

    Each task sums its own texts; what reaches the driver is one row per language of COMMON_WORDS and task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                raw = (value or "").encode()
                words = raw.split()
                if name not in WORD_FORMS or len(words) < MIN_WORDS_DIVERGENCE:
                    continue
                chars, by_lang = histograms(raw, words, [name])
                row = np.concatenate([chars / chars.sum(), by_lang[name] / len(words), [1.0]])
                sums[name] = sums.get(name, 0) + row
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": [x.tolist() for x in sums.values()]}, pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))]))

    part = map_texts(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), "text", work, "lang string, sums array<double>")
    width = CLASSES + max(map(len, WORD_FORMS.values())) + 2
    total = part.groupBy("lang").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = {}
    for row in total.collect():
        values = np.array([x for x in row[1:] if x is not None])
        out[row[0]] = (values[:CLASSES] / values[-1], values[CLASSES:-1] / values[-1])
    return out


def nearest(hists: list[dict], chars: np.ndarray, n_words: np.ndarray, refs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each text to its nearest reference by characters and by words; nan below the minimum lengths."""
    far_chars, far_words = np.full(len(hists), np.nan), np.full(len(hists), np.nan)
    long_chars, long_words = chars.sum(axis=1) >= MIN_CHARS, n_words >= MIN_WORDS_DIVERGENCE
    if refs and long_chars.any():
        far_chars[long_chars] = np.min([distances(chars[long_chars], r[0]) for r in refs.values()], axis=0)
    if refs and long_words.any():
        own = [h for h, w in zip(hists, long_words) if w]
        far_words[long_words] = np.min([distances(np.array([h[k] for h in own]), r[1]) for k, r in refs.items()], axis=0)
    return far_chars, far_words


SCHEMA = (
    "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, char_distance double, word_distance double"
)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """One row per document with its counts, distances and verdict; references are learned from `docs` unless given."""
    refs = references(docs, text, lang) if refs is None else refs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hists, chars = [], [], []
            strange = np.array([name is not None and name not in refs for name in batch.column("lang").to_pylist()], bool)
            for value in batch.column("text").to_pylist():
                raw = (value or "").encode()
                words = raw.split()
                own, by_lang = histograms(raw, words)
                counts.append(counted(raw, words, own))
                hists.append(by_lang)
                chars.append(own)
            table = np.array(counts)
            failed = (table[:, 0] < MIN_WORDS) | (100 * table[:, 4] > REPEAT_PERCENT * table[:, 0])
            far_chars, far_words = nearest(hists, np.array(chars), table[:, 0], refs)
            kept = ~failed & (strange | ~((far_chars > MAX_CHAR_DISTANCE) | (far_words > MAX_WORD_DISTANCE)))
            columns = [*map(pa.array, table.T), pa.array(failed), pa.array(kept), pa.array(far_chars, from_pandas=True), pa.array(far_words, from_pandas=True)]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return map_texts(inputs, "text", work, SCHEMA.format(id=inputs.schema["doc_id"].dataType.simpleString()))
