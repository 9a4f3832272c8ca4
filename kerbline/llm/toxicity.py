"""Toxicity: a chain of linear classifiers, one per category, each fed the earlier categories' probabilities.

A document's features are its distinct words (lower case, cut at ASCII characters other than letters) and
their starts. A
link of the chain is a logistic regression over the words that tell its category apart best (by the
likelihood ratio, chosen anew in every fit) and over the probabilities of the links before it. For
training, those probabilities are out of fold: each comes from a model that never saw the row.

Categories before the last are weak labels found in the labelled rows of each language: the words that tell
its toxic rows best are dealt to the categories by which of them occur together, and a toxic row is in a
category when it holds one of the category's words. The last link is the label itself; a document is
rejected when its probability reaches ``threshold``.

The chain is fitted on a bounded sample of labelled rows: the ``sample_rows`` ids of each label with the
smallest hash (of repeated labels of an id the larger counts, null labels don't; of an id's texts the one
with the smallest hash). The sample lies in a table; words are counted and chosen in Spark, and the driver
holds the chosen words only, ``FEATURES`` a fit at most, and which of them each sampled row has. Scoring
is one pass over all documents without a shuffle. Null and empty texts have no words. Without labelled rows
of both kinds every probability is 0 and nothing is rejected. Further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import fresh, stored

CATEGORIES = ("words_a", "words_b")
#: Telling words of a language that make up its categories.
SEED_WORDS = 10
LAST = "toxic"
SAMPLE_ROWS = 3000
FEATURES = 300
MIN_ROWS = 3
FOLDS = 4
PENALTY = 1.0
THRESHOLD = 0.25
#: Lengths in bytes of the starts of words that are features too; they carry over to unseen endings.
STARTS = (4, 5)

_CUT = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words, and the starts of the longer ones, marked by a star."""
    if not text:
        return set()
    words = set(text.lower().encode("utf-8", "replace").translate(_CUT).split())
    starts = {w[:n] + b"*" for n in STARTS for w in words if len(w) > n}
    return words | starts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Link:
    """One category: word weights, weights of the earlier links' probabilities, and the intercept."""

    name: str
    words: dict[bytes, float]
    earlier: np.ndarray
    intercept: float

    def of(self, rows: list[set[bytes]], earlier: np.ndarray) -> np.ndarray:
        weights, known = self.words, self.words.keys()
        z = np.array([sum(map(weights.__getitem__, known & row)) for row in rows], dtype=float) + self.intercept
        return _sigmoid(z + earlier @ self.earlier) if earlier.shape[1] else _sigmoid(z)


def likelihood_ratio(n: np.ndarray, n_yes: np.ndarray, rows: float, rows_yes: float) -> np.ndarray:
    """How well a word's presence tells the label: sum of observed * log(observed / expected) over the four cells."""
    total = 0.0
    for seen, row, column in (
        (n_yes, n, rows_yes), (n - n_yes, n, rows - rows_yes), (rows_yes - n_yes, rows - n, rows_yes),
        (rows - rows_yes - n + n_yes, rows - n, rows - rows_yes),
    ):
        expected = np.maximum(row * column / np.maximum(rows, 1), 1e-300)
        total = total + seen * np.log(np.maximum(seen, 1) / expected) * (seen > 0)
    return total


def fit_link(name: str, rows: list[frozenset[bytes]], y: np.ndarray, earlier: np.ndarray, names: list[bytes]) -> Link:
    """Ridge logistic regression over ``names`` by Newton steps; a label with one value gives a constant near it."""
    if len(np.unique(y)) < 2:
        p = (y.sum() + 0.01) / (len(y) + 1) if len(y) else 0.01
        return Link(name, {}, np.zeros(earlier.shape[1]), float(np.log(p / (1 - p))))
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(rows), len(names) + earlier.shape[1] + 1))
    for i, row in enumerate(rows):
        x[i, [at[w] for w in at.keys() & row]] = 1.0
    x[:, len(names):-1] = earlier
    x[:, -1] = 1.0
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(12):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return Link(name, {w: float(b[i]) for w, i in at.items()}, b[len(names):-1].copy(), float(b[-1]))


def fit_chain(
    rows: list[frozenset[bytes]], labels: dict[str, np.ndarray], fold: np.ndarray, chosen: Callable[[str, int | None], list[bytes]],
) -> list[Link]:
    """Links in the order of ``labels``; ``fold`` numbers the fold of each row.

    ``chosen(link, out)`` names the words of the fit of that link without the rows of fold ``out`` (None: with all).
    """
    chain: list[Link] = []
    earlier = np.zeros((len(rows), 0))
    for name, y in labels.items():
        chain.append(fit_link(name, rows, y, earlier, chosen(name, None)))
        held = np.zeros(len(rows))
        for k in np.unique(fold):
            out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            link = fit_link(name, [rows[i] for i in rest], y[rest], earlier[rest], chosen(name, int(k)))
            held[out] = link.of([rows[i] for i in out], earlier[out])
        earlier = np.column_stack([earlier, held])
    return chain


def chain_probabilities(chain: list[Link], rows: list[set[bytes]]) -> np.ndarray:
    earlier = np.zeros((len(rows), 0))
    for link in chain:
        earlier = np.column_stack([earlier, link.of(rows, earlier)])
    return earlier


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, lang: str, sample_rows: int) -> DataFrame:
    """(id, y, lang, words, fold), written; at most ``sample_rows`` rows of each label, one per id."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        picked = part if picked is None else picked.unionAll(part)

    @F.pandas_udf("array<binary>")
    def words(column: pd.Series) -> pd.Series:
        return pd.Series([sorted(words_of(x)) for x in column], dtype=object)

    language = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    # At most twice sample_rows ids: a proven bound for the broadcast.
    joined = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), language.alias("lang")).join(F.broadcast(picked), "id")
    single = joined.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("r"))
    worded = single.select("id", "y", F.col("r.lang").alias("lang"), words("r.text").alias("words"))
    # Equal texts share a fold, so a copy of a row never predicts it.
    return stored(worded.withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(FOLDS)).cast("int")))


def category_words(sample: DataFrame) -> dict[str, list[list[bytes]]]:
    """Per language, the words of each category.

    The ``SEED_WORDS`` whole words that tell the language's toxic rows best: the first opens the first
    category, the word that shares the least of its rows with it the next, and every other word joins the
    category whose opening word it shares most of its rows with (the first of equals).
    """
    per_lang = sample.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("y").alias("rows_yes"))
    counted = sample.select("lang", "y", F.explode("words").alias("w")).where(F.substring("w", -1, 1) != b"*").groupBy("lang", "w").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_yes")).where(F.col("n") >= MIN_ROWS).join(per_lang, "lang")

    @F.pandas_udf("double")
    def worth(n: pd.Series, n_yes: pd.Series, rows: pd.Series, rows_yes: pd.Series) -> pd.Series:
        return pd.Series(likelihood_ratio(*(x.to_numpy(dtype=float) for x in (n, n_yes, rows, rows_yes))))

    more = F.col("n_yes") * F.col("rows") > F.col("n") * F.col("rows_yes")
    scored = counted.where(more).withColumn("score", worth("n", "n_yes", "rows", "rows_yes"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "w"))
    best: dict[str, list[bytes]] = {}
    for r in scored.withColumn("rank", rank).where(F.col("rank") <= SEED_WORDS).orderBy("lang", "rank").collect():
        best.setdefault(r["lang"], []).append(bytes(r["w"]))
    if not best:
        return {}
    have = _kept_words(sample.where("y = 1"), {w for ws in best.values() for w in ws}).select("lang", "kept").collect()
    rows: dict[str, list[set[bytes]]] = {}
    for r in have:
        rows.setdefault(r["lang"], []).append({bytes(w) for w in r["kept"]})
    out = {}
    for lang, words in best.items():
        def shared(a: bytes, b: bytes) -> float:
            with_a = [x for x in rows.get(lang, []) if a in x]
            return sum(b in x for x in with_a) / max(1, len(with_a))

        openers = [words[0]]
        while len(openers) < min(len(CATEGORIES), len(words)):
            openers.append(min((w for w in words if w not in openers), key=lambda w: max(shared(w, o) for o in openers)))
        groups: list[list[bytes]] = [[] for _ in CATEGORIES]
        for w in words:
            at = openers.index(w) if w in openers else max(range(len(openers)), key=lambda i: shared(w, openers[i]))
            groups[at].append(w)
        out[lang] = groups
    return out


def _kept_words(sample: DataFrame, wanted: set[bytes]) -> DataFrame:
    @F.pandas_udf("array<binary>")
    def keep(column: pd.Series) -> pd.Series:
        return pd.Series([[w for w in ws if w in wanted] for ws in column], dtype=object)

    return sample.withColumn("kept", keep("words"))


def _marked(sample: DataFrame, by_lang: dict[str, list[list[bytes]]]) -> DataFrame:
    """``sample`` with ``marks``: 1 or 0 per category, and last the label."""
    sets = {lang: [frozenset(g) for g in groups] for lang, groups in by_lang.items()}
    none = [frozenset()] * len(CATEGORIES)

    @F.pandas_udf("array<int>")
    def marks(lang: pd.Series, words: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[*[int(t and not g.isdisjoint(ws)) for g in sets.get(l, none)], int(t)] for l, ws, t in zip(lang, words, y)], dtype=object)

    return sample.withColumn("marks", marks("lang", "words", "y"))


def telling_words(marked: DataFrame, n_features: int = FEATURES) -> dict[tuple[str, int | None], list[bytes]]:
    """Per (link, fold left out), the words that tell the link's label best; ties by the word.

    One aggregation counts every word by fold and label; the best of each fit are chosen from that.
    """
    links = (*CATEGORIES, LAST)
    by_fold = marked.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.element_at("marks", i + 1)).alias(f"y{i}") for i in range(len(links))]).collect()
    totals = {r["fold"]: r for r in by_fold}
    counters, names = [], []
    for k in range(FOLDS):
        inside = F.col("fold") == k
        counters.append(F.sum(F.when(inside, 1).otherwise(0)))
        counters += [F.sum(F.when(inside, F.element_at("marks", i + 1)).otherwise(0)) for i in range(len(links))]
        names += [f"n_{k}", *[f"y{i}_{k}" for i in range(len(links))]]
    counters, width = [c.alias(n) for c, n in zip(counters, names)], len(names)
    counted = marked.select("fold", "marks", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *counters).where(F.col("n") >= MIN_ROWS)
    fits = {}
    for i, link in enumerate(links):
        for out in (None, *range(FOLDS)):
            kept = [k for k in range(FOLDS) if k != out]
            rows, yes = (float(sum(totals[k][c] for k in kept if k in totals)) for c in ("n", f"y{i}"))
            if 0 < yes < rows:
                fits[link, out] = ([k * (len(links) + 1) for k in kept], i + 1, rows, yes)
    if not fits:
        return {}
    shapes = list(fits.values())

    @F.pandas_udf("array<double>")
    def scores(column: pd.Series) -> pd.Series:
        counts = np.stack(list(column)).astype(float) if len(column) else np.zeros((0, width))
        table = np.empty((len(counts), len(shapes)))
        for f, (starts, link, rows, yes) in enumerate(shapes):
            n, n_yes = counts[:, starts].sum(axis=1), counts[:, [s + link for s in starts]].sum(axis=1)
            table[:, f] = np.where(n >= MIN_ROWS, likelihood_ratio(n, n_yes, rows, yes), np.nan)
        return pd.Series(list(table))

    listed = counted.select("w", F.array(*[F.col(c) for c in names]).alias("counts"))
    ranked = listed.select("w", F.posexplode(scores("counts")).alias("fit", "score")).where(~F.isnan("score"))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("fit").orderBy(F.desc("score"), "w"))).where(F.col("rank") <= n_features)
    order, out = list(fits), {f: [] for f in fits}
    for r in best.select("fit", "rank", "w").orderBy("fit", "rank").collect():
        out[order[r["fit"]]].append(bytes(r["w"]))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
) -> list[Link]:
    sample = labelled_sample(docs, labels, id, text, label, lang, sample_rows)
    if sample.agg(F.count_distinct("y")).first()[0] < 2:
        return []
    marked = stored(_marked(sample, category_words(sample)))
    chosen = telling_words(marked)
    known = _kept_words(marked, {w for words in chosen.values() for w in words}).select("id", "y", "fold", "marks", "kept").orderBy("id").collect()
    shared: dict[bytes, bytes] = {}
    rows = [frozenset(shared.setdefault(bytes(w), bytes(w)) for w in r["kept"]) for r in known]
    labels_of = {c: np.array([r["marks"][i] for r in known]) for i, c in enumerate((*CATEGORIES, LAST))}
    return fit_chain(rows, labels_of, np.array([r["fold"] for r in known]), lambda link, out: chosen.get((link, out), []))


def probabilities(chain: list[Link], text: Column, names: tuple[str, ...]) -> Column:
    """A struct with one probability per link."""

    known = frozenset().union(*[link.words.keys() for link in chain])

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(column: pd.Series) -> pd.DataFrame:
        rows = [known & words_of(x) for x in column]  # of a batch of texts, only the words that count are held
        p = chain_probabilities(chain, rows) if chain else np.zeros((len(rows), len(names)))
        return pd.DataFrame(p, columns=list(names))

    return score(text)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", into: str = "toxicity", lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add ``into``: the probability of each category and, last, of the label."""
    chain = fit(docs, labels, id, text, label, lang, sample_rows)
    return docs.withColumn(into, probabilities(chain, F.col(text), (*CATEGORIES, LAST)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    into = fresh(docs, "__toxicity")
    return score_toxicity(docs, labels, into=into, **options).where(F.col(into)[LAST] < threshold).drop(into)
