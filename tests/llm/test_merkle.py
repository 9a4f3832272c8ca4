import hashlib
import zlib

import pytest

from kerbline.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        found.append((at % 2, level[at ^ 1] if (at ^ 1) < len(level) else None))
        at //= 2
    return found


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for at_top, g in enumerate(order):
        for at, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], at) + siblings(top, at_top)
            now = r if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:3], r[3] + 1, r[4])
            f = leaf(now)
            for right, s in path:
                f = sha(f) if s is None else sha(s, f) if right else sha(f, s)
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha(*[s for _, s in path if s]), f, f == top[-1][0]))
    return sorted(map(repr, out))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = merkle.verified_manifest(docs.selectExpr("*", "1 as key", "2 as h", "3 as rank")).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected(rows)
    return got


def rows(lang, n, first=0):
    return [(first + 3 * i, f"s{i % 4}", lang, 10 * i, f"text {i} of {lang} é") for i in range(n)]


def test_sizes_around_runs_digits_and_blocks(spark):
    docs, first = [], 0
    for i, n in enumerate((1, 2, 3, 5, 31, 32, 33, 64, 65, 1023, 1024, 1025, 1100)):
        docs += rows(f"l{i}", n, first)
        first += 5000
    got = check(spark, docs)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


@pytest.mark.parametrize("digit, digits", [(1, 1), (1, 2), (2, 1), (2, 3)])
def test_many_tiers(spark, monkeypatch, digit, digits):
    monkeypatch.setattr(merkle, "DIGIT", digit)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    check(spark, rows("a", 37) + rows("b", 8, 1000) + rows("c", 1, 2000) + rows(None, 9, 3000) + rows("", 2, 4000))


def test_many_groups(spark):
    check(spark, [(i, None, f"g{i % 150}", None if i % 5 else i, "x" * (i % 9)) for i in range(400)])


def test_nulls_repeated_rows_and_ids(spark):
    docs = [(None, None, None, None, None), (None, "s", "a", 1, "no id"), (None, "s", "a", 1, "no id"), (7, "s", "a", 1, "one"), (7, "s", "a", 1, "one"),
            (7, "s", "a", 2, "two"), (8, "s", "a", 9_223_372_036_854_775_807, ""), (14, "s", "a", 9_223_372_036_854_775_807, " \n"), (9, "s", "b", 1, "z" * 100_000)]
    check(spark, docs)
    check(spark, docs[:1])
    check(spark, [(1, "s", "a", 1, "same")] * 200)
    assert check(spark, [(5, "s", "a", 1, "only")])[0].leaf == check(spark, [(5, "s", "a", 1, "only")])[0].root


def test_empty_table(spark):
    assert merkle.verified_manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_proofs_come_without_a_join(spark):
    """The explode reads blocks and what lies above them through one grouping."""
    node = spark.createDataFrame([("a", 0, "x")], "key string, rank long, h string")
    blocks = merkle._blocks(node, [])
    plan = merkle._handed_down([blocks], None, [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == merkle.DIGITS
