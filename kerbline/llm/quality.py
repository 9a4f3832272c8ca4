"""Quality rules: decision lists learned by sequential covering, run as ordered Spark conditions.

One pass over the texts measures each document. From a bounded sample of labelled documents, rules for
low quality are learned one after another. A rule is a conjunction of thresholds: on two thirds of the
sample it grows by the condition with the highest information gain until it covers no good document (or
``MAX_CONDITIONS``); on the other third its last conditions are pruned while that raises precision
(p - n) / (p + n). A rule that is precise enough there joins the list, the low-quality rows it covers go,
and the search goes on with the rest. The list becomes one CASE expression: the number of the first rule
that holds, 0 if none does. Thresholds have four significant digits, so rules can be read.

The sample: the ``SAMPLE_ROWS`` labelled rows with the smallest hash of the id (of repeated ids the larger
label counts, null labels don't; of an id's texts the one with the smallest hash). Null texts have no words. A table without labels gives no rules, and
only the fixed rules decide. Repeated rows each get their own result; a line without a word is never a
repeated line.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000
MAX_CONDITIONS = 4
MAX_RULES = 24
MIN_PRECISION = 0.95
MIN_COVER = 5
CUTS = 48
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_bangs", "longest")


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES``; characters are code points."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), *[0] * (len(MEASURES) - 3))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeated = 0
    if n > 3:
        triples = list(zip(words, words[1:], words[2:]))
        if len(set(triples)) < len(triples):
            often = {t for t, c in Counter(triples).items() if c > 1}
            end = 0
            for i, t in enumerate(triples):
                if t in often:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return (
        n, len(text) - count(_BLANK), count(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), count(_UPPER),
        count(_DIGITS), count(_MARKS), raw.count(b"!"), max(map(len, words)))


def measures(text: str = "text") -> Column:
    """A struct of ``MEASURES``."""

    @F.pandas_udf(", ".join(f"{m} bigint" for m in MEASURES))
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in column], columns=list(MEASURES)).astype("int64")

    return run(F.col(text))


def features(m: str) -> dict[str, Column]:
    """What rules may speak of, from the struct column ``m``."""
    c = lambda name: F.col(f"{m}.{name}").cast("double")
    words, chars, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return {
        "words": c("n_words"), "mean_word": c("word_chars") / words, "symbols_per_word": c("n_symbols") / words,
        "dup_line_share": c("n_dup_lines") / lines, "repeat_share": c("n_repeat_words") / words, "distinct_share": c("n_distinct") / words,
        "upper_share": c("n_upper") / chars, "digit_share": c("n_digits") / chars, "marks_per_word": c("n_marks") / words,
        "bangs_per_word": c("n_bangs") / words, "words_per_line": c("n_words") / lines, "longest_word": c("longest"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def column(self, columns: dict[str, Column]) -> Column:
        at = columns[self.feature]
        return at > F.lit(self.value) if self.above else at <= F.lit(self.value)


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _cuts(values: np.ndarray) -> list[float]:
    """Thresholds between values, at even ranks, with four significant digits."""
    levels = np.unique(values)
    if len(levels) < 2:
        return []
    at = np.unique(np.linspace(0, len(levels) - 2, CUTS).astype(int))
    return sorted({float(f"{(levels[i] + levels[i + 1]) / 2:.4g}") for i in at})


def grow(x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """Conditions by the highest gain p * (log2 precision after - log2 precision before)."""
    rule: list[Condition] = []
    inside = np.ones(len(low), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = (inside & low).sum(), (inside & ~low).sum()
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], low[inside]
            for cut in _cuts(v):
                for above in (True, False):
                    on = v > cut if above else v <= cut
                    p = (on & y).sum()
                    if p >= MIN_COVER:
                        g = p * (np.log2(p / on.sum()) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(name, above, cut), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.feature])
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """The first conditions of ``rule`` that do best on rows it was not grown on; the shorter of equals."""

    def worth(r: Rule) -> float:
        on = covered(r, x, len(low))
        p, n = (on & low).sum(), (on & ~low).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], low: np.ndarray, grows: np.ndarray) -> list[Rule]:
    """The decision list; ``grows`` marks rows for growing, the others prune."""
    rules: list[Rule] = []
    left = np.ones(len(low), dtype=bool)
    while len(rules) < MAX_RULES and (left & low & grows).sum() >= MIN_COVER:
        g, h = left & grows, left & ~grows
        rule = grow({k: v[g] for k, v in x.items()}, low[g])
        rule = prune(rule, {k: v[h] for k, v in x.items()}, low[h])
        if not rule:
            break
        on = covered(rule, x, len(low)) & left
        held = on & ~grows
        if not (held & low).sum() or (held & low).sum() < MIN_PRECISION * held.sum() or (on & low).sum() < MIN_PRECISION * on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max(label).alias("__y"))
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # At most sample_rows ids: a proven bound for the broadcast.
    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
    # One text per id, so rows are bounded as ids are.
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("r")).select("__id", "__y", F.col("r.__text").alias("__text"))
    measured = rows.select("__id", "__y", F.xxhash64("__text").alias("__h"), measures("__text").alias("__m"))
    sample = measured.select("__id", "__y", "__h", *[c.alias(k) for k, c in features("__m").items()]).toPandas()
    if sample.empty:
        return []
    sample = sample.sort_values(["__id", "__h"], ignore_index=True)
    names = [c for c in sample.columns if not c.startswith("__")]
    # Equal texts fall on one side, so a rule is never pruned on a copy of what it grew on.
    grows = sample["__h"].to_numpy() % 3 != 0
    return learn({k: sample[k].to_numpy() for k in names}, sample["__y"].to_numpy() == 0, grows)


def rule_number(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        on = rule[0].column(columns)
        for c in rule[1:]:
            on = on & c.column(columns)
        out = F.when(on, F.lit(i)) if out is None else out.when(on, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, the measures, base_failed, rule, kept) for every row of ``docs``."""
    rules = fit_rules(docs, labels, id, text, label, sample_rows)
    m = docs.select(F.col(id), F.col(text).alias("__text")).select(F.col(id), measures("__text").alias("__m"))
    failed = (F.col("__m.n_words") < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__m.n_words"))
    judged = m.withColumns({"base_failed": failed, "rule": rule_number(rules, features("__m"))})
    return judged.select(id, "__m.*", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
