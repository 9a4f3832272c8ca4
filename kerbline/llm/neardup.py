"""Near-duplicate documents: circulant MinHash, bands, exact Jaccard verification, components.

A document's set holds its distinct five-word shingles (one shingle of all words where there are fewer).
Two permutations make every signature coordinate: the first maps a shingle to a place in 0 .. 2**32-1, the
second is applied after a circular shift by k for coordinate k, and the least value counts. Five
coordinates make a band; 40 bands give a pair with similarity 0.75 a chance of 2e-5 to share none.

1. One pass over the texts gives (id, set size, digest of the set, band keys, low bytes of the signature).
   Equal sets are folded into one row first, so copies cost nothing further.
2. Stars: every member of a band's bucket is paired with the bucket's smallest id. A pair whose
   signatures agree in less than ``LEAST_AGREEMENT`` of the coordinates (over six standard deviations
   below 0.75) goes; the others are confirmed on full sets, and links give components.
3. A bucket that still holds several components may hide further links. Its largest component is cut into
   blocks, the other members visit every block and each other. Inside a task, signatures tell which rows
   may have a partner in another component; these rows get their full sets and meet again in the same
   block, where every two rows of different components are compared exactly. Only links that join
   components leave a task, never pairs. Pairs inside a component need no check: they are connected already.

No bucket is capped, no group is gathered in one task, and nothing but counts and a bitmap of fixed size
reaches the driver. Within a
bucket that many documents share without being linked, the comparing in blocks is quadratic; exactness
demands it, and rows that no signature brings near another are out before sets are read.

Null texts and texts without words have an empty set: size 0, linked with nothing, a component of their
own. Rows that share an id are one node: what one of them is linked with, all are, whatever their texts. Rows
without an id have no component, link nothing and are kept. Ties don't arise; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import fresh, stored
from kerbline.session import cut_lineage

SHINGLE = 5
BANDS = 40
BAND_ROWS = 5
COORDINATES = BANDS * BAND_ROWS
LEAST_AGREEMENT = 0.55
#: Bits of the filter that goes ahead of the two large joins: 8 MB.
FILTER_BITS = 1 << 26
#: Rows of a block in which signatures are compared.
BLOCK = 1024
_SLICE = 1024

_SHIFTS = np.arange(1, COORDINATES + 1, dtype=np.uint32)
_BAND_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_BAND_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words_each: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z count as a-z."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(words_each, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = total * _FACTOR + h[i:len(words) - width + 1 + i]
    return np.unique(_mix64(total))


def signature(items: np.ndarray) -> np.ndarray:
    """The least value of every coordinate."""
    place = (items >> np.uint64(32)).astype(np.uint32)  # the first permutation
    least = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(place), _SLICE):
        x = place[at:at + _SLICE, None] + _SHIFTS  # shifted round modulo 2**32, then the second permutation
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return _mix64((rows * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS).view(np.int64)


def sketch(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, digest, bands, low); of an empty set only id and n."""
    fields = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, x in zip(batch["id"], batch["text"]):
                items = shingles(x)
                if len(items):
                    least = signature(items)
                    rows.append((key, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), band_keys(least), (least & 0xFF).astype(np.uint8).tobytes()))
                else:
                    rows.append((key, 0, None, None, None))
            yield pd.DataFrame(rows, columns=fields.names)

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, fields)


def _agreeing(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""

    @F.pandas_udf("int")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        l = np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), -1)
        r = np.frombuffer(b"".join(y), dtype=np.uint8).reshape(len(y), -1)
        return pd.Series((l == r).sum(axis=1).astype("int32"))

    l = marks.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("low").alias("al"))
    r = marks.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("low").alias("bl"))
    sized = F.least("an", "bn") >= F.lit(threshold - 1e-9) * F.greatest("an", "bn")
    return pairs.join(l, "a").join(r, "b").where(sized).where(agreement("al", "bl") >= LEAST_AGREEMENT * COORDINATES).select("a", "b")


def maybe_in(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> tuple[DataFrame, Broadcast]:
    """Rows of ``df`` without most of those whose ``column`` is not among the wanted values, and what to destroy afterwards.

    A bitmap of hashed values, ``FILTER_BITS`` long whatever the tables' sizes, goes to the tasks. A join
    decides afterwards; it then moves little more than what it keeps.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS)) + 1
    marked = wanted.select(place(wanted_column).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in marked.toLocalIterator():
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        bitmap[(row["bucket"] - 1) * len(bits):row["bucket"] * len(bits)] = bits
    shipped = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked_value(p: pd.Series) -> pd.Series:
        at = p.to_numpy() - 1
        return pd.Series((shipped.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return df.where(marked_value(place(column))), shipped


def full_sets(docs: DataFrame, needed: DataFrame, id: str, text: str) -> tuple[DataFrame, Broadcast]:
    """(id, items) of the documents in ``needed`` (id), and what to destroy afterwards. Texts travel, not hashed sets, which are larger."""

    @F.pandas_udf("binary")
    def full(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).tobytes() for x in column], dtype=object)

    needed = cut_lineage(needed)
    likely, shipped = maybe_in(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "id", needed, "id")
    return likely.join(needed, "id", "left_semi").select("id", full("text").alias("items")), shipped


def confirm(docs: DataFrame, pairs: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets; written."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for k, (l, r) in enumerate(zip(x, y)):
            l, r = np.frombuffer(l, dtype=np.uint64), np.frombuffer(r, dtype=np.uint64)
            both = np.concatenate([l, r])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out[k] = 100 * common >= percent * (len(both) - common)
        return pd.Series(out)

    needed = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets, shipped = full_sets(docs, needed, id, text)
    l, r = sets.withColumnsRenamed({"id": "a", "items": "ai"}), sets.withColumnsRenamed({"id": "b", "items": "bi"})
    out = cut_lineage(pairs.join(l, "a").join(r, "b").where(linked("ai", "bi")).select("a", "b"))
    shipped.destroy()
    return out


def components(links: DataFrame) -> DataFrame:
    """(v, label): for every end of a link, the smallest id reachable.

    Each round maps a vertex to its least neighbour or itself and that one's least in turn, then replaces
    the ends of the links. Links within one vertex go, so a group shrinks by a factor in every round. Rounds
    start from written tables, whose plans carry nothing over from earlier rounds.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        parent = stored(parent)
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("v", F.col("pp").alias("p"))
        parent = stored(parent)
        if labels is None:
            labels = parent.withColumnRenamed("p", "label")
        else:
            step = parent.select(F.col("v").alias("label"), F.col("p").alias("next"))
            labels = stored(labels.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label")))
        pa, pb = parent.withColumnsRenamed({"v": "a", "p": "x"}), parent.withColumnsRenamed({"v": "b", "p": "y"})
        edges = stored(edges.join(pa, "a").join(pb, "b").where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return labels


def _visits(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (key, rep, label, ...) dealt to blocks (key, i, j), each on a side.

    The largest component of a bucket is cut into blocks i < 0 and stands on the left there, each row
    once; all other rows visit these on the right, and meet each other in blocks i <= j.
    """
    counts = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    shape = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    shape = shape.select("key", F.col("top.label").alias("top"), F.ceil(F.col("top.c") / BLOCK).alias("bulk_blocks"),
                         F.ceil(F.greatest(F.col("all") - F.col("top.c"), F.lit(1)) / BLOCK).alias("other_blocks"))
    bulk, h, zero = F.col("label") == F.col("top"), F.xxhash64("rep"), F.lit(0).cast("long")
    own = F.pmod(h, F.col("other_blocks"))
    visit = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    visits = F.when(bulk, F.array(visit(-1 - F.pmod(h, F.col("bulk_blocks")), zero, 0))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(1).cast("long"), F.col("bulk_blocks")), lambda b: visit(-b, zero, 1)),
        F.transform(F.sequence(own, F.col("other_blocks") - 1), lambda j: visit(own, j, 0)),
        F.transform(F.sequence(zero, own), lambda i: visit(i, own, 1)),
    ))
    return members.join(shape, "key").select(*members.columns, F.explode(visits).alias("at")).select("key", "at.*", *members.columns[1:])


def _by_block(dealt: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame | None], fields: T.StructType) -> DataFrame:
    """``run`` over each block's rows, one block of a sorted partition after another."""
    group = ["key", "i", "j"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = held[group].to_numpy()
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *ends[:-1]], ends):
                out = run(held.iloc[lo:hi]) if hi - lo > 1 else None
                if out is not None and len(out):
                    yield out
            if len(ends):
                held = held.iloc[ends[-1]:].reset_index(drop=True)
        out = run(held) if held is not None and len(held) > 1 else None
        if out is not None and len(out):
            yield out

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).sortWithinPartitions(*group).mapInPandas(scan, fields)


def _sides(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame] | None:
    side = part["side"].to_numpy()
    return None if side.min() == side.max() else (part[side == 0], part[side == 1])


def _hopeful(members: DataFrame, threshold: float) -> DataFrame:
    """The rows (key, i, j, side, rep, label) that some row of another component in their block agrees with.

    ``members``: key, rep, label, n, low.
    """
    dealt = _visits(members)
    fields = T.StructType([dealt.schema[c] for c in ("key", "i", "j", "side", "rep", "label")])

    def hopeful(part: pd.DataFrame) -> pd.DataFrame | None:
        sides = _sides(part)
        if sides is None:
            return None
        l, r = sides
        lm = np.frombuffer(b"".join(l["low"]), dtype=np.uint8).reshape(len(l), -1)
        rm = np.frombuffer(b"".join(r["low"]), dtype=np.uint8).reshape(len(r), -1)
        ln, rn, ll, rl = l["n"].to_numpy(), r["n"].to_numpy(), l["label"].to_numpy(), r["label"].to_numpy()
        l_on, r_on = np.zeros(len(l), dtype=bool), np.zeros(len(r), dtype=bool)
        for k in range(len(r)):
            able = np.flatnonzero((ll != rl[k]) & (np.minimum(ln, rn[k]) >= threshold * np.maximum(ln, rn[k]) - 1e-6))
            if len(able):
                hit = able[(lm[able] == rm[k]).sum(axis=1) >= LEAST_AGREEMENT * COORDINATES]
                l_on[hit] = True
                r_on[k] = len(hit) > 0
        return pd.concat([l[l_on], r[r_on]])[fields.names]

    return _by_block(dealt, hopeful, fields)


def _bridges(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components with a confirmed link; of a block's rows only those that join something.

    ``rows``: what :func:`_hopeful` gives, and the full sets, ``items``.
    """
    label = rows.schema["label"].dataType
    fields = T.StructType([T.StructField("a", label), T.StructField("b", label)])

    def bridges(part: pd.DataFrame) -> pd.DataFrame | None:
        sides = _sides(part)
        if sides is None:
            return None
        l, r = sides
        sets = [np.frombuffer(x, dtype=np.uint64) for x in l["items"]]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(known), dtype=np.int64)
        names, at = np.unique(np.concatenate([l["label"].to_numpy(), r["label"].to_numpy()]), return_inverse=True)
        root, out = at.copy(), []  # of every row, the component it belongs to by now
        for k, x in enumerate(r["items"]):
            mine = np.frombuffer(x, dtype=np.uint64)
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            place = place[known[place] == mine]
            own = root[len(l) + k]
            if not len(place) or (root[:len(l)] == own).all():
                continue
            mark[place] = 1
            common = np.add.reduceat(mark[codes], starts)
            mark[place] = 0
            for i in np.flatnonzero((100 * common >= percent * (sizes + len(mine) - common)) & (root[:len(l)] != own)):
                other = root[i]
                if other != own:
                    out.append((names[at[i]], names[at[len(l) + k]]))
                    root[root == other] = own
        return pd.DataFrame(out, columns=["a", "b"])

    return _by_block(rows, bridges, fields).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    threshold = percent / 100
    sketches = stored(sketch(docs, id, text))
    reps = stored(
        sketches.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct(F.col("id"), F.col("n"), F.col("bands"), F.col("low"))).alias("r"))
        .select("digest", F.col("r.id").alias("rep"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands"), F.col("r.low").alias("low")))
    marks = reps.select("rep", "n", "low")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    hubs = stored(
        buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("size"))
        .where(F.col("hub") < F.col("last")).select("key", "hub", "size"))
    likely, shipped = maybe_in(buckets, "key", hubs, "key")
    shared = stored(likely.join(hubs, "key"))  # only buckets with two members or more
    shipped.destroy()
    stars = shared.where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    checked = cut_lineage(_agreeing(stars, marks, threshold))
    links = confirm(docs, checked, id, text, percent)
    labels = components(links)

    # A bucket of two was settled by its star.
    placed = shared.where(F.col("size") > 2).join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") < F.col("hi")).select("key")
    members = placed.join(mixed, "key", "left_semi").join(marks, "rep").select("key", "rep", "label", "n", "low")
    hopeful = stored(_hopeful(members, threshold))
    if not hopeful.isEmpty():
        sets, shipped = full_sets(docs, hopeful.select(F.col("rep").alias("id")).distinct(), id, text)
        bridges = stored(_bridges(hopeful.join(sets.withColumnRenamed("id", "rep"), "rep"), percent))
        shipped.destroy()
        joined = components(bridges).select(F.col("v").alias("label"), F.col("label").alias("next"))
        alone = joined.join(labels.select(F.col("v").alias("label")), "label", "left_anti").select(F.col("label").alias("v"), F.col("next").alias("label"))
        labels = labels.join(joined, "label", "left").select("v", F.coalesce("next", "label").alias("label")).unionAll(alone)
    classes = reps.select("digest", F.col("rep").alias("v")).join(labels, "v", "left").select("digest", F.coalesce("label", "v").alias("label"))
    classes = _one_per_id(sketches, classes)
    out = sketches.select("id", "n", "digest").join(classes, "digest", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _one_per_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (digest, label) with the classes joined that different texts of one id lie in."""
    sets = sketches.where((F.col("n") > 0) & F.col("id").isNotNull()).select("id", "digest")
    several = cut_lineage(sets.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where(F.col("lo") < F.col("hi")).select("id"))
    if several.isEmpty():
        return classes
    classes = stored(classes)
    held = sets.join(several, "id", "left_semi").distinct().join(classes, "digest").select("id", "label")
    least = held.groupBy("id").agg(F.min("label").alias("a"))
    joined = components(held.join(least, "id").select("a", F.col("label").alias("b"))).select(F.col("v").alias("label"), F.col("label").alias("next"))
    return classes.join(joined, "label", "left").select("digest", F.coalesce("next", "label").alias("label"))


def _row_key(docs: DataFrame, id: str, text: str) -> Column:
    """One value per id and text, in the order of the id."""
    h = F.xxhash64(F.col(text))
    if isinstance(docs.schema[id].dataType, T.IntegralType):
        return F.col(id).cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.shiftrightunsigned(h, 2).cast("decimal(19,0)")
    return F.concat(F.col(id).cast("string"), F.lit("\0"), F.hex(h))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of each group of near-duplicate texts, with its columns; rows without an id stay.

    What goes has a near duplicate or a copy that stays, or one linked with it through others. Different
    texts under one id are documents of their own; rows equal in id and text are one.
    """
    known, key = docs.where(F.col(id).isNotNull()), fresh(docs, "__key")
    texts = known.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    # Only where ids are shared by different texts do rows need a longer key than the id.
    own = F.col(id) if texts.where(F.col("lo") < F.col("hi")).isEmpty() else _row_key(docs, id, text)
    keyed = known.withColumn(key, own)
    gone = near_duplicates(keyed, key, text, percent).where(~F.col("kept")).select(key).distinct()
    rest = keyed.join(gone, key, "left_anti").dropDuplicates([key]).drop(key)
    return rest.unionByName(docs.where(F.col(id).isNull()))
