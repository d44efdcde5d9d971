"""Quality rules, quality classifier and language ID on the odd table."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tripleloom.llm import language_id, quality_classifier, quality_rules


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_rule_counts_equal_plain_python(docs):
    texts = docs.select("doc_id", "text").collect()
    found = quality_rules.quality_rules(docs).collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_divergence_takes_junk_and_leaves_prose(spark):
    prose = "the cat and the dog of the house is in that garden with a tree, for it was on the road. "
    rows = [(i, " ".join((prose * 6).split()[i % 9 :]) + f" item{i}", "en") for i in range(40)]
    rows += [(90, " | ".join(f"zorg{i} blen{i * 7}" for i in range(80)), "en"), (91, " ".join(f"THE{i}!! OF{i}!!" for i in range(80)), "en")]
    found = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not found[90].kept and not found[91].kept
    assert all(found[i].char_distance < quality_rules.MAX_CHAR_DISTANCE and found[i].word_distance < quality_rules.MAX_WORD_DISTANCE for i in range(40))


def test_distance_is_jensen_shannon():
    p, q = np.array([[1.0, 2, 3, 0]]) * 1e9, np.array([2.0, 2, 0, 2])
    a, b = p[0] / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m) if u)
    assert quality_rules.distances(p, q)[0] == pytest.approx(((kl(a) + kl(b)) / 2) ** 0.5, abs=1e-6)


def test_rules_of_empty_table(empty):
    assert rows_of(quality_rules.quality_rules(empty)) == []


def test_language_id(docs):
    found = language_id.language_id(docs).collect()
    langs = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        text = langs[r.doc_id][1]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == langs[r.doc_id][0]


def test_language_kernel_equals_sets():
    a, b = "the cat sat", "The hat, sad"

    def features(t):
        raw = (" " + t.lower() + " ").encode().translate(language_id.BLANKED)
        return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}

    codes = np.unique(language_id.grams(b))
    model = language_id.Model(["x"], codes, np.ones((len(codes), 1), np.float32), np.array([len(codes)], np.float32), np.zeros((1, 1)))
    shared = features(a) & features(b)
    assert len(codes) == len(features(b))
    found = model.kernel(*model.presence([np.unique(language_id.grams(a))], model.slots()))
    assert found[0, 0] == pytest.approx(len(shared) / (len(features(a)) * len(features(b))) ** 0.5, rel=1e-5)


def test_fit_equals_kernel_ridge_regression_from_its_definition(docs):
    """The same landmarks and rows, kernels from sets, weights from the normal equations."""
    model = language_id.train(docs.where("doc_id < 60"))
    texts = sorted((str(r.doc_id), r.lang, r.text) for r in docs.where("doc_id < 60").collect())
    by_lang = {}
    for _, lang, text in texts:
        by_lang.setdefault(lang, []).append(set(language_id.grams(text).tolist()))
    langs = sorted(by_lang)
    turns = sorted((i, lang) for lang in langs for i in range(len(by_lang[lang])))
    marks = [by_lang[lang][i] for i, lang in turns[:96]]
    sets = [(lang, g) for lang in langs for g in by_lang[lang]]
    known = set().union(*marks)

    def kernel(rows):
        return np.array([[len(r & m) / (len(r) * len(m)) ** 0.5 for m in marks] for r in rows])

    values, vectors = np.linalg.eigh(kernel(marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))
    features = kernel([g for _, g in sets]) @ root
    truth = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in sets])
    weights = root @ np.linalg.solve(features.T @ features + 1e-2 * len(sets) / len(marks) * np.eye(len(marks)), features.T @ truth)
    asked = ["the cat sat in the house", "der hund und die katze", "quelque chose d'autre"]
    want = kernel([set(language_id.grams(t).tolist()) for t in asked]) @ weights
    got = model.scores(*model.presence([np.unique(language_id.grams(t)) for t in asked], model.slots()))
    assert model.langs == langs and set(model.codes.tolist()) == known
    assert np.abs(got - want).max() < 2e-3


def test_numerals_are_no_letters(spark, docs):
    model = language_id.train(docs)
    asked = spark.createDataFrame([(1, "½ ² ³ ①"), (2, "Ⅷ 12"), (3, "ª")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.predict(asked, model).collect()} == {1: True, 2: True, 3: False}


def test_foreign_random_and_encoded_texts_are_rejected(spark):
    import base64
    import random

    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(8).collect()]
    foreign = [
        "Это обычный русский текст о погоде и о том как люди живут в большом городе зимой и летом.",
        "Αυτό είναι ένα απλό ελληνικό κείμενο για τον καιρό και για τη ζωή στην πόλη.",
        "这是一个关于天气和城市生活的普通中文文本。人们在冬天和夏天的生活。",
        "Tämä on tavallinen suomenkielinen teksti säästä ja siitä miten ihmiset elävät suuressa kaupungissa talvella ja kesällä.",
        "To jest zwykły polski tekst o pogodzie i o tym, jak ludzie żyją w dużym mieście zimą i latem.",
        rng.randbytes(300).hex(), base64.b64encode(rng.randbytes(300)).decode(), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)),
    ]
    rows = [(10_000 + i, t) for i, t in enumerate(foreign)] + [(20_000 + i, f"{a}\n{b}") for i, (a, b) in enumerate(zip(texts, texts[1:]))]
    added = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in language_id.identified(docs.unionByName(added, allowMissingColumns=True)).collect()}
    assert not {i for i in kept if 10_000 <= i < 20_000}
    assert len({i for i in kept if i >= 20_000}) == 7 and len({i for i in kept if i < 10_000}) == docs.count()


def test_nothing_to_learn(docs, empty):
    assert rows_of(language_id.language_id(empty)) == []
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}


def test_language_filter_keeps_columns(docs):
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()}
    assert {100, 101, 102, 103} <= gone and not gone & set(range(60))


@pytest.fixture(scope="module")
def judged(spark):
    import random

    rng = random.Random(4)
    words = "the of and to in cat dog house tree road garden stone river light paper music".split()
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(60))
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text + ".", "en", f"src{i % 5}", len(text)))
        if i < 150:
            labels.append((i, int(not bad), 0))
    labels += [(0, None, None), (9999, 1, 0), (None, 1, 0)]
    rows += [(400, None, None, None, None), (401, "", "en", "src1", 0), (None, words[0], None, None, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_rows_without_labels(judged):
    found = {r.doc_id: r for r in quality_classifier.quality_classifier(*judged).collect()}
    assert len(found) == 303
    assert all(found[i].kept == (i % 6 != 0) for i in range(150, 300))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_classifier_filter_and_missing_labels(judged, empty):
    docs, labels = judged
    assert quality_classifier.good(docs, labels).columns == docs.columns
    assert quality_classifier.good(docs, labels.where("false")).count() == docs.count()
    assert quality_classifier.good(docs, labels.where("quality = 1")).count() == docs.count()
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.where("false")).collect()} == {None}
    assert rows_of(quality_classifier.quality_classifier(empty, labels)) == []


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 900)
    views = [np.column_stack([y * 3.0 + rng.normal(size=900), rng.normal(size=900)]) for _ in range(2)]
    few, rest = slice(0, 60), slice(60, 700)
    model = quality_classifier.co_train([v[few] for v in views], y[few], [v[rest] for v in views], sure=0.9)
    score = model.scores([v[700:] for v in views])[2]
    assert ((score > 0.5) == (y[700:] == 1)).mean() > 0.95


def test_prose_of_a_language_without_reference_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    italian = "Questo è un normale testo italiano sul tempo, su come le persone vivono in una grande città e su quello che fanno la sera. "
    polish = "To jest zwykły polski tekst o pogodzie, o tym, jak ludzie żyją w dużym mieście, i co robią wieczorem po długim dniu pracy. "
    more = ["Poi tornano a casa, cenano con gli amici e parlano di quello che è successo.", "Potem wracają do domu, jedzą kolację i rozmawiają o tym, co się stało."]
    rows = [(10_001, italian + more[0] + " Il giorno dopo si alzano presto e prendono il treno per andare al lavoro, come sempre, anche quando piove forte.", "it")]
    rows += [(10_002, polish + more[1] + " Następnego dnia wstają wcześnie i jadą pociągiem do pracy, jak zawsze, nawet kiedy mocno pada deszcz i wieje wiatr.", "pl")]
    found = quality_rules.quality_rules(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True))
    assert {r.doc_id: r.kept for r in found.where("doc_id > 10000").collect()} == {10_001: True, 10_002: True}
