"""Quality rules and the toxicity chain: measures against plain counting, and held-out accuracy."""

import re
from collections import Counter

from collections import Counter

import numpy as np
import pytest

from kerbline.llm import quality, toxicity

SF_DIR = "/root/testdata/sf0.1"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(triples)
    inside = {i + j for i, t in enumerate(triples) if count[t] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "a", "a b c", "a a a a a", "a b c a b c", "a b c d a b c d a", "x\ny\nx\n\n\nx \n \n", "##| é\x85b\x1cc d <*> \x0b\x0c\r z",
    "a b a b a b x y z x y z q", "\n".join(["line one"] * 5 + ["  "] * 3), "😀 😀 😀 😀 ü",
])
def test_measures(text):
    assert quality.measure(text)[:5] == plain(text)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def halves(labels):
    return labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")


def test_quality_on_held_out_labels(spark, tables):
    docs, labels = tables
    fit, held = halves(labels.select("doc_id", "quality"))
    got = quality.judge_quality(docs, fit).join(held, "doc_id").select("kept", "base_failed", "quality").toPandas()
    got = got[~got.base_failed]
    assert (got.kept == (got.quality == 1)).mean() > 0.99
    assert got[got.quality == 1].kept.mean() > 0.99


def test_rules_are_found_and_pruned():
    r = np.random.default_rng(0)
    x = {"a": r.random(3000), "b": r.random(3000), "noise": r.random(3000)}
    low = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = quality.learn(x, low, np.arange(3000) % 3 != 0)
    on = np.zeros(3000, dtype=bool)
    for rule in rules:
        on |= quality.covered(rule, x, 3000)
    assert (on == low).mean() > 0.98
    assert quality.learn(x, r.random(3000) < 0.3, np.arange(3000) % 3 != 0) == []
    assert quality.learn(x, np.zeros(3000, dtype=bool), np.arange(3000) % 3 != 0) == []


def test_toxicity_on_held_out_labels(spark, tables):
    docs, labels = tables
    fit, held = halves(labels.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs, fit).join(held, "doc_id").select("toxicity.toxic", held.toxic.alias("truth")).toPandas()
    rejected = got.iloc[:, 0] >= toxicity.THRESHOLD
    # Some 250 toxic rows to learn from, in four languages; on 10,000 labels hardly any is missed.
    assert rejected[got.truth == 1].mean() > 0.88
    assert rejected[got.truth == 0].mean() < 0.01


def telling(rows, y, n_features=toxicity.FEATURES):
    """The words with the highest likelihood ratio with the label, counted one by one."""
    def worth(w):
        total = 0.0
        for on in (True, False):
            for label in (0, 1):
                seen = sum((w in row) == on and t == label for row, t in zip(rows, y))
                row, column = sum((w in r) == on for r in rows), sum(t == label for t in y)
                total += seen * np.log(seen * len(rows) / (row * column)) if seen else 0.0
        return total

    often = Counter(w for row in rows for w in row)
    return sorted((-round(worth(w), 9), w) for w, n in often.items() if n >= toxicity.MIN_ROWS)[:n_features]


def test_words_are_chosen_as_by_hand(spark):
    """Counted and chosen in Spark, for every link and fold left out."""
    r = np.random.default_rng(2)
    rows = [sorted({b"w%d" % i for i in r.choice(25, 6)}) for _ in range(120)]
    marks = [[int(b"w1" in row and b"w2" in row), int(b"w3" in row), int(b"w1" in row or b"w3" in row)] for row in rows]
    table = spark.createDataFrame([(i % toxicity.FOLDS, m, [bytearray(w) for w in row]) for i, (m, row) in enumerate(zip(marks, rows))], "fold int, marks array<int>, words array<binary>")
    got = toxicity.telling_words(table, 10)
    assert len(got) == 3 * (1 + toxicity.FOLDS)
    for (link, out), words in got.items():
        inside = [i for i in range(len(rows)) if out is None or i % toxicity.FOLDS != out]
        want = telling([rows[i] for i in inside], [marks[i][(*toxicity.CATEGORIES, toxicity.LAST).index(link)] for i in inside], 10)
        worth = {w: s for s, w in telling([rows[i] for i in inside], [marks[i][(*toxicity.CATEGORIES, toxicity.LAST).index(link)] for i in inside], 99)}
        assert [worth[w] for w in words] == [s for s, _ in want]


def test_categories_come_from_each_languages_rows(spark):
    rows = [(i, f"{'ugly nasty' if i % 4 else 'vile mean'} word{i % 7}" if i % 2 else f"fine word{i % 7}", "en") for i in range(80)]
    rows += [(100 + i, f"{'haesslich boese' if i % 4 == 1 else 'gemein fies'} wort{i % 7}" if i % 2 else f"schoen wort{i % 7}", "de") for i in range(80)]
    docs = spark.createDataFrame([(i, t.replace("nasty", "nasty" if i % 3 else "awful"), l) for i, t, l in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", "lang", 500)
    groups = toxicity.category_words(sample)
    assert set(groups) == {"en", "de"} and all(len(g) == 2 for g in groups.values())
    of = {w: i for i, g in enumerate(groups["de"]) for w in g}
    assert of[b"haesslich"] == of[b"boese"] != of[b"gemein"] == of[b"fies"]
    scored = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((scored[i].toxic >= 0.5) == (i % 2 == 1) for i, _, _ in rows)
    a, b = (toxicity.CATEGORIES[of[w]] for w in (b"haesslich", b"gemein"))
    assert scored[101][a] > 0.5 > scored[101][b] and scored[103][b] > 0.5 > scored[103][a]


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(3000)] + [(2, "b", "en"), (3, "c", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", "lang", 10)
    assert sorted((r.id, r.y) for r in sample.collect()) == [(1, 1), (2, 0), (3, 0)]
    assert quality.fit_rules(docs, labels.withColumnRenamed("toxic", "quality")) == []


def test_later_links_use_earlier_ones():
    r = np.random.default_rng(1)
    vocabulary = [b"w%d" % i for i in range(40)]
    rows = [frozenset(r.choice(40, 8, replace=False).tolist()) for _ in range(800)]
    rows = [frozenset(vocabulary[i] for i in row) for row in rows]
    first = np.array([int(b"w0" in row or b"w1" in row) for row in rows])
    labels = {"first": first, "second": (first & np.array([int(b"w2" in row) for row in rows])), "any": first}
    fold = np.arange(800) % 4
    chain = toxicity.fit_chain(rows, labels, fold, lambda link, out: vocabulary)
    assert [len(link.earlier) for link in chain] == [0, 1, 2]
    assert chain[2].earlier[0] > 1
    p = toxicity.chain_probabilities(chain, rows)
    assert ((p[:, 2] > 0.5) == (first == 1)).mean() > 0.98


def test_labels_of_one_kind_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 3
