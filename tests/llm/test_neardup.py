import random
from collections import defaultdict

import pytest

from kerbline.llm import neardup


def shingle_set(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = (text or "").translate(table).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(size, component) per place in ``rows``; every two sets are compared."""
    sets = [shingle_set(t) for _, t in rows]
    distinct = {s: rows[i][0] for i, s in reversed(list(enumerate(sets))) if s and rows[i][0] is not None}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            distinct[s] = min(distinct[s], i)
    reach = {i: i for i in distinct.values()}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    keys = list(distinct)
    for k, s in enumerate(keys):
        for t in keys[:k]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(distinct[s]), find(distinct[t])
                reach[max(a, b)] = min(a, b)
    return [(len(s), find(distinct[s]) if s and i is not None else i) for (i, _), s in zip(rows, sets)]


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(30, 160))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(0, 8)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 20)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(r.randrange(20, 70))] + passage) for _ in range(40)]
    texts += [texts[0].upper(), texts[0] + " ", None, "", " \n", "one two", "ONE  two", "one two three", "é É", "É é"]
    r.shuffle(texts)
    return [(7 * i % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1024, 3])
def test_components_equal_comparing_all(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), (n, c) in zip(rows, brute(rows)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_pairs_that_stars_miss(spark):
    """A bucket's smallest id links with neither of two documents that link with each other."""
    words = [f"w{i}" for i in range(100)]
    a, b = words[:60] + [f"x{i}" for i in range(40)], words[:60] + [f"y{i}" for i in range(40)]
    c = list(b)
    c[99] = "z"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    r = random.Random(2)
    links = [(x, y) if r.random() < 0.5 else (y, x) for x, y in chain + star] + [(200, 201), (201, 200), (5, 5)]
    got = {r.v: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df).collect()) == ["1", "None", "None"]


def test_signatures_estimate_similarity():
    r = random.Random(5)
    for share in (0.3, 0.6, 0.75, 0.9):
        both = [" ".join(r.choice("abcdefghijkl") * 3 + str(r.random()) for _ in range(5)) for _ in range(int(1000 * share))]
        x = neardup.shingles(" ".join(both) + " " + " ".join(str(r.random()) for _ in range(1000 - len(both))))
        y = neardup.shingles(" ".join(both) + " " + " ".join(str(r.random()) for _ in range(1000 - len(both))))
        truth = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
        assert abs((neardup.signature(x) == neardup.signature(y)).mean() - truth) < 0.15


def test_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{n}{i}" for i in range(30)) for n in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, c)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 7: 3, 9: 3, 11: 11}
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(3, "a"), (7, "b"), (11, "c")]
    kept = neardup.keep_one(spark.createDataFrame([(5, a), (5, b), (5, b), (None, a), (None, a), (6, ""), (6, None)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept), key=repr) == sorted([(5, a), (5, b), (0, a), (0, a), (6, ""), (6, None)], key=repr)
    kept = neardup.keep_one(spark.createDataFrame([("x", a), ("x", b), ("y", a), ("z", a + " more")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [("x", "a"), ("x", "b")]
