"""A roster's digest tells different rosters apart and ignores row order."""

from kerbline.operators import reconcile

COLUMNS = "endpoint string, label string, codec string, width int"


def digest(spark, rows):
    return reconcile.roster_digest(spark.createDataFrame([("e", *r) for r in rows], COLUMNS), ["endpoint"]).first().digest


def test_a_missing_value_is_not_the_word(spark):
    assert digest(spark, [("a", None, 1)]) != digest(spark, [("a", "null", 1)])


def test_separators_in_values_do_not_collide(spark):
    rows = [[("a|codec=x", "y", 1)], [("a", "x|codec=y", 1)], [('a","codec":"x', "y", 1)], [("a", 'x","label":"a', 1)]]
    assert len({digest(spark, r) for r in rows}) == len(rows)


def test_order_does_not_matter(spark):
    rows = [(f"c{i}", "h264", i) for i in range(30)]
    assert digest(spark, rows) == digest(spark, rows[::-1]) != digest(spark, rows[1:])
