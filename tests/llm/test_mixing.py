from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kerbline.llm import mixing


def plain_targets(sizes):
    """Resharing by weight, round by round, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {**target, **share}
        for s in above:
            target[s] = Fraction(3 * sizes[s])
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


CASES = [
    {"a": 100, "b": 1, "c": 2, "d": 5, None: 300, "é": 40, "Z": 7},
    {"a": 10}, {"a": 1, "b": 1000}, {"a": 0, "b": 9}, {f"s{i:03}": (i * 37) % 101 for i in range(60)}, {"x": 0},
    {"a": 1, "b": 2, "c": 3, "d": 1000, "e": 1, "f": 5},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    rows = [(k or "", k is None, v) for k, v in sizes.items()]
    got = mixing.source_targets(spark.createDataFrame(rows, "__s string, __none boolean, source_size long")).collect()
    want = plain_targets(sizes)
    assert {(r["__s"], r["__none"]) for r in got} == {(k or "", k is None) for k in sizes}
    for r in got:
        assert r["target"] == pytest.approx(float(want[None if r["__none"] else r["__s"]]))
        assert r["target"] <= 3 * r["source_size"]


def docs(spark, n=3000):
    text = F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(90)).cast("int")), lambda x: F.lit("w")), " ")
    source = F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 7))
    return spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), source.alias("source"))


def test_words_taken(spark):
    rows = mixing.mix_sources(docs(spark)).collect()
    assert len(rows) == 3000
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s]))
        assert {r.source_size for r in rows if r.source == s} == {sizes[s]}
        assert abs(taken[s] - target[s]) <= 1.5 * largest[s]


def test_copies_follow_from_the_order(spark):
    """The same sums, added up one document after another."""
    rows = mixing.mix_sources(docs(spark)).collect()
    offsets = {r.s: r.u for r in spark.createDataFrame([(s,) for s in {r.source for r in rows}], "s string").select(
        "s", F.pmod(F.xxhash64(F.col("s").isNull(), F.coalesce("s", F.lit("")), F.lit(mixing.SEED)), F.lit(mixing.PARTS)).alias("u")).collect()}
    hashes = {r.doc_id: r.h for r in spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(mixing.SEED)).alias("h")).collect()}
    for s, at in offsets.items():
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.size, hashes[r.doc_id], r.doc_id)):
            after = at + int(r.target / r.source_size * mixing.PARTS)
            assert r.copies == after // mixing.PARTS - at // mixing.PARTS
            at = after


def test_rows_are_taken_as_often_as_counted(spark):
    df = docs(spark, 400).withColumns({"copies": F.lit("x"), "size": F.lit(1), "lang": F.lit(None).cast("string")})
    df = df.unionAll(df.where("doc_id < 40"))  # repeated rows
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        want[r.doc_id] += r.copies
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in want.items() if v}
