"""License scan and language identification."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.llm import language, licenses


def scan(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in licenses.scan_licenses(df, **options).orderBy("doc_id").collect()]


def test_whole_templates_and_their_spans(spark):
    texts = [f"é words before. {t} words after" for t in licenses.TEMPLATES.values()]
    for (name, template), text, found in zip(licenses.TEMPLATES.items(), texts, scan(spark, texts)):
        assert [(m.license, m.coverage) for m in found] == [(name, 1.0)]
        assert licenses.words_of(text[found[0].start:found[0].end]) == licenses.words_of(template)


def test_changed_words_are_aligned(spark):
    r = random.Random(7)
    text = licenses.TEMPLATES["MIT-permission"].split()
    for _ in range(20):
        words = list(text)
        for _ in range(5):
            at = r.randrange(len(words))
            words[at:at + 1] = r.choice([[], ["changed"], [words[at], "added"]])
        [found] = scan(spark, ["x y " + " ".join(words)])
        assert [m.license for m in found] == ["MIT-permission"] and 0.8 <= found[0].coverage < 1


def test_nothing_and_many(spark):
    got = scan(spark, [None, "", "no licence here", "All rights", "rights reserved all", "\n".join(["All rights reserved."] * 50), "x " * 100_000 + "released UNDER the (MIT) license"])
    assert [len(x) for x in got] == [0, 0, 0, 0, 0, 50, 1]


def test_alignment_equals_the_longest_common_words():
    r = random.Random(3)
    for _ in range(200):
        a = [b"%d" % r.randrange(6) for _ in range(r.randrange(3, 12))]
        b = [b"%d" % r.randrange(6) for _ in range(r.randrange(3, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (a[i] == b[j]) if abs(j - i) <= licenses._band(a) else 0)
        m = licenses.align(a, b, 0, 0)
        best = m.matched if m else 0
        assert best <= table[-1][-1]
        if max(len(a), len(b)) <= licenses._band(a) + 1:
            assert best == table[-1][-1]


SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_text_alone_on_held_out_documents(spark, docs):
    names, model = language.fit_text_model(docs, sample_rows=400)
    held = docs.orderBy(F.xxhash64("doc_id").desc()).limit(600).select("text", "lang").collect()
    right = sum(names[model[:, language.trigrams(r.text)].sum(axis=1).argmax()] == r.lang for r in held)
    assert right > 0.97 * len(held)


def test_evidence_adds_up(spark, docs):
    some = docs.where("length(text) > 300").orderBy("doc_id").limit(200).select("doc_id", "text", "lang").collect()
    pages = [(i, f"http://{r.lang}.example.{r.lang}/p", f'<html lang="{r.lang}"><p>{r.text}</p>') for i, r in enumerate(some)]
    german = [(1000 + i, "http://de.example.de/q", html) for i, html in enumerate(["", None, '<html lang="de">', "<p>7</p>"])]
    got = {r.page_id: r for r in language.identify_languages(spark.createDataFrame(pages + german, "page_id long, url string, html string"), docs, sample_rows=400).collect()}
    assert sum(got[i].lang == r.lang for i, r in enumerate(some)) > 0.97 * len(some)
    assert [got[1000 + i].lang for i in range(4)] == ["de"] * 4
    assert got[1002].confidence > got[1000].confidence > 0.5


def test_visible_text():
    assert "track" not in language.visible('<html><head><title>t</title></head><script>track(0);</script><p>a&amp;b</p><!-- c --></html>')
    assert language.visible("<p>one</p><p>two</p>").split() == ["one", "two"]


def test_a_rare_language_is_a_label_and_takes_no_other_pages(spark, docs):
    known = docs.select("doc_id", "text", "lang").orderBy("doc_id").limit(1500)
    finnish = "Tervetuloa sivuillemme! Tarjoamme palveluita koko maassa, ja asiakkaat ovat meille t\u00e4rkeit\u00e4."
    last = known.orderBy(F.xxhash64("doc_id").desc()).first().doc_id  # no sample of the whole reaches this id
    corpus = known.withColumn("text", F.when(F.col("doc_id") == last, finnish).otherwise(F.col("text"))).withColumn(
        "lang", F.when(F.col("doc_id") == last, "fi").otherwise(F.col("lang")))
    names, model = language.fit_text_model(corpus, sample_rows=100)
    assert "fi" in names and set(names) == {r.lang for r in corpus.select("lang").distinct().collect()}
    said = lambda x: names[model[:, language.trigrams(x)].sum(axis=1).argmax()]
    assert said("Asiakkaat ovat meille t\u00e4rkeit\u00e4") == "fi"
    assert said("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059") != "fi" and said("\u017dlu\u0165ou\u010dk\u00fd k\u016f\u0148") != "fi"


def test_licences_torn_apart_and_whole_texts(spark):
    mit, gpl = licenses.TEMPLATES["MIT-text"].split(), licenses.TEMPLATES["GPL-3-text"].split()
    foreign = [f"w{i}" for i in range(40)]
    short = licenses.TEMPLATES["MIT-permission"].split()
    texts = [short[:30] + foreign + short[30:], mit[:80] + foreign + mit[80:], gpl[:2000] + foreign + gpl[2000:], gpl[:2000] + gpl[2300:], mit + foreign + mit]
    got = [[(m.license, round(m.coverage, 2)) for m in found] for found in scan(spark, [" ".join(x) for x in texts])]
    assert got[:3] == [[("MIT-permission", 1.0)], [("MIT-text", 1.0)], [("GPL-3-text", 1.0)]]
    assert [x for x, _ in got[3]] == ["GPL-3-text"] and 0.9 < got[3][0][1] < 1
    assert got[4] == [("MIT-text", 1.0)] * 2


def longest_common(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def test_common_subsequence_equals_the_table_of_all_cells():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(0, 90))] for _ in range(2))
        assert licenses._between(a, b) == longest_common(a, b)


@pytest.mark.parametrize("stretch", [900, 2000])
def test_foreign_words_in_long_stretches(spark, stretch):
    words = licenses.TEMPLATES["GPL-3-text"].split()
    torn = words[:1000]
    for i in range(1000, 1000 + stretch, 2):
        torn += [*words[i:i + 2], "foreign"]
    [found] = scan(spark, [" ".join(torn + words[1000 + stretch:])])
    assert [(m.license, m.coverage) for m in found] == [("GPL-3-text", 1.0)]


def test_long_templates_whose_fingerprints_all_repeat(spark):
    """No fingerprint occurs once, so chains have nothing to follow; the band does."""
    lines = " ".join(["alpha beta gamma delta"] * 100)
    [found, torn] = scan(spark, [f"x {lines} y", f"x {lines.replace('delta alpha', 'delta foreign alpha', 3)} y"], templates={"lines": lines})
    assert [(m.license, m.coverage) for m in found] == [("lines", 1.0)]
    assert [(m.license, m.coverage) for m in torn] == [("lines", 1.0)]
