import datetime

import numpy as np
from pyspark.sql import functions as F

from kerbline.operators import clockread

AT = 1781395200000  # 14 June 2026, midnight


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def stamp(second):
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=second)).strftime("%d%m%Y%H%M%S")


def plainly(text, expected_ms, window_s):
    """(proposed_ms, score before rounding, whether halved), every second tried."""
    seen = "".join(x for x in text or "" if x in "0123456789")
    if len(seen) < 10:
        return None, 0.0, False
    tried = sorted((edits(stamp(expected_ms // 1000 + d), seen), abs(d), d) for d in range(-window_s, window_s + 1))[:40]
    score = lambda r: 1.0 - r[0] / max(14, len(seen))
    best = tried[0]
    if score(best) < 0.78:
        return None, score(best), False
    return expected_ms + best[2] * 1000, score(best), any(
        score(r) >= score(best) - 0.02 and abs(r[2] - best[2]) > 90 for r in tried[1:])


def test_distances_to_every_second_of_an_hour():
    digits = lambda texts: np.array([[int(x) for x in t] for t in texts], "int32")
    seen = ["14062026072930", "14062026972938", "00000000000000", "40620260729301"]
    hours = ["1406202607", "1406202607", "3112199923", "1406202607"]
    got = clockread._distances(digits(seen), digits(hours))
    for text, hour, row in zip(seen, hours, got):
        assert [int(x) for x in row] == [edits(f"{hour}{s // 60:02d}{s % 60:02d}", text) for s in range(3600)]
    long = "9" * 40 + "14062026072930"
    assert clockread._distances(digits([long]), digits(hours[:1]))[0, 29 * 60 + 30] == 40


def test_reads_like_trying_every_second(spark):
    texts = ["14-06-2026 00:00:10", "14-06-2026 00:00:1", "14-06-2026 2359", "13-06-2026 23:59:50", "140620260000", "1406202600000" * 5,
             "06-2026 00:01:00", "14-06-2O26 00:OO:30", "9999999999", "٣٣٣٣٣٣٣٣٣٣٣", "", None, "14-06-2026 01:00:00 or 02"]
    rows = [(i, t, AT + shift) for shift in (0, -1, 3_599_999, 1_234_567) for i, t in enumerate(texts)]
    rows += [(0, "31-12-1969 23:59:58", -1500), (0, "31-12-1969 23:59:58", None)]
    frame = spark.createDataFrame(rows, "id int, ocr_text string, expected_ms bigint")
    for window_s in (1800, 130, 5):
        got = {(r.id, r.expected_ms): r for r in clockread.resolve_reads(frame, window_s).collect()}
        for i, text, expected in rows:
            r = got[i, expected]
            if expected is None:
                assert (r.proposed_ms, r.score) == (None, None)
                continue
            proposed, score, halved = plainly(text, expected, window_s)
            assert (r.proposed_ms, r.score) == (proposed, round(score * (0.5 if halved else 1), 3)), (text, expected, window_s)


def test_a_read_is_resolved_in_one_pass(spark):
    reads = spark.range(3).select(F.lit("14-06-2026 00:00:10").alias("ocr_text"), F.lit(AT).alias("expected_ms"))
    plan = clockread.resolve_reads(reads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "levenshtein" not in plan
