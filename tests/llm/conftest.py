"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, size int, score string, shard string, salt int"

LINES = {
    "en": "the cat and the dog of the house is in that garden with a tree for it was on the road",
    "de": "der hund und die katze in den garten von das haus mit sich für auf ist im nicht dem ein",
    "fr": "le chat et la maison dans les jardins du village qui est une route pour que avec par sur",
}


def _texts():
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        words = LINES[lang].split()
        k = i % len(words)
        rows.append((i, " ".join(words[k:] + words[:k]) + f" word{i % 7} {i}.\nNext line {i % 5}, end.", lang))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, f"src{r[0] % 4}", len(r[1])) for r in _texts()]
    rows += [(100, None, "en", None, None), (101, "", None, "src0", 0), (102, "   \n\t ", "xx", "src1", 6), (103, "12345 67 ### %%%", None, None, 16)]
    rows += [(104, "a", "en", "src1", 1), (105, "two words", None, "src1", None), (None, "a text without an id but with some words in it", "en", "src2", 40)]
    rows += [(110, rows[0][1], "en", "src0", 9), (110, rows[0][1], "en", "src0", 9), (111, rows[0][1].upper(), "en", "src3", 9)]
    rows += [(120 + i, "copy of the same hot text that many rows hold " * 3, "en", "src0", 1) for i in range(40)]
    rows += [(200, "x" * 50_000, "en", "src0", 50_000), (201, "long words and more of them " * 3000, "en", "src0", 81_000), (202, "naïve İstanbul 世界 😀 \x1c\x85 ￿ café'll 3½", "fr", "src0", 30)]
    return spark.createDataFrame([(*r, 7, 7, "s", "t", 1) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where(F.lit(False))
