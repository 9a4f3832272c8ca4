import random
import zlib
from collections import Counter

from kerbline.llm import sharding


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shards_of(spark, rows, **options):
    got = sharding.shard_documents(table(spark, rows), **options).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    return got


def spread(got):
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    return max(sizes) - min(sizes), sum(sizes)


def test_equal_bytes(spark):
    r = random.Random(1)
    rows = [(i, "é" * r.randrange(0, 400)) for i in range(4000)]
    got = shards_of(spark, rows)
    texts = dict(rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.crc == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    gap, total = spread(got)
    assert gap <= 0.002 * total / 8 + 2 * 801


def test_a_text_with_most_of_the_rows_is_split(spark):
    rows = [(i, "copy " * 20) for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(1500)]
    got = shards_of(spark, rows)
    gap, total = spread(got)
    assert gap <= 0.002 * total / 8 + 2 * 101
    # Other equal texts stay together.
    pairs = [(i, f"pair {i // 2} " * 9) for i in range(1000)]
    got = {r.doc_id: r.shard for r in shards_of(spark, pairs)}
    assert sum(got[i] != got[i + 1] for i in range(0, 1000, 2)) <= 7


def test_one_row_repeated_for_half_the_table(spark):
    rows = [(7, "again " * 8)] * 1000 + [(10_000 + i, f"text {i} " * 6) for i in range(1000)]
    got = shards_of(spark, rows)
    gap, total = spread(got)
    assert gap <= 0.002 * total / 8 + 2 * 61 and min(Counter(r.shard for r in got).values()) > 100


def test_few_repeated_and_missing_rows(spark):
    shards_of(spark, [(1, None), (1, None), (None, ""), (2, "x" * 100_000), (3, "a"), (3, "a")])
    shards_of(spark, [(1, "one")])
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_one_exchange_and_no_python(spark):
    keys = table(spark, [(1, "x")])
    plan = sharding.document_keys(keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_slots_follow_the_key_over_all_parts(spark):
    """Against sorting on one machine: equal texts lie next to each other, whatever the number of parts."""
    rows = [(i, f"text {i % 500}") for i in range(4000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        got = sharding.shard_documents(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashes = {r.id: (r.h, r.g >> sharding.TIE_BITS) for r in sharding.document_keys(table(spark, rows)).collect()}
    in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(hashes, key=hashes.__getitem__)
    texts = [i % 500 for i in in_order]
    assert sum(a != b for a, b in zip(texts, texts[1:])) == 499
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
