"""Merkle manifest of a dataset by a nested-struct rollup, with a proof for every row.

Rows become leaves and get their rank within their group's order. A rank is written in digit columns of
base 2**DIGIT. Digits are grouped away one after the other, the last one first: a group's children become
an array of structs in the order of the digit, and the nodes of the DIGIT levels above them are hashed
from that array, two at a time. After ``DIGITS`` digits a block is complete: one row that holds all its
leaves and inner nodes, at most 2**(DIGIT * DIGITS) leaves. The block's own hash is a leaf of the next
tier, where the same is done again, until every group has one block. The groups' roots are ranked and
rolled up the same way.

Proofs come down tier by tier. A block and the proof of its root meet by a grouping on the block's number
(two rows a group), never in a join; a transform over the nested levels gives every child its siblings,
and an explode makes rows of the children.

A run of one node, at the end of a level, is hashed alone. Ranks have no gaps, so a node without a left
neighbour whose children are fewer than a full digit is the whole level: then hashing stops at one node.

One group may hold any share of the rows: ranks come from an even cut by range with small counts per
(group, part) carried on, and rows of one key are told apart by a running number, so repeated rows are
spread too. Which of two equal rows comes first is arbitrary, and their results are the same multiset.

A null value is hashed as ``-``, an empty text is not null. Nulls come first in every order: rows without
an id are leaves like others, rows without a group are a group. Rows of one id stand in order of their
leaves. A lone row is its own subroot, a lone subroot is the root, and their proofs are the hash of
nothing. An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import stored
from kerbline.operators.sequence import stitched

DIGIT = 5
DIGITS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return joined_hash(*[field(v) for v in values])


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, ...) with ``rank``, from 0 along ``order`` within the key; nulls first."""
    numbered = stored(rows.withColumn("tie", F.monotonically_increasing_id()))
    cut = ["key", *order, "tie"]
    # Bounds of a range cut differ from run to run, so the cut is written before anything counts on it.
    placed = stored(numbered.repartitionByRange(_parts(rows), *[F.col(c) for c in cut]).withColumn("part", F.spark_partition_id()))
    counted = stitched(placed, keys=["key"], order=[*order, "tie"], chunk=F.col("part"), running_sum={"rank": F.lit(1).cast("long")})
    return counted.select(*rows.columns, (F.col("rank") - 1).alias("rank"))


def _two_by_two(level: Column) -> Column:
    pair = lambda i: joined_hash(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def _grouped_away(df: DataFrame, keys: list[str], digit: str, carried: list[str]) -> DataFrame:
    """Group ``digit`` away: (keys, h, node); ``node`` nests the children and the levels of hashes above them.

    ``keys`` after the first are the digits that stay, higher ones first.
    """
    child = F.struct(F.col(digit).alias("digit"), "h", *carried)
    out = df.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("kids"))
    first = F.lit(True)
    for k in keys[1:]:
        first = first & (F.col(k) == 0)
    out = out.withColumns({"lone": first & (F.size("kids") < 1 << DIGIT), "l0": F.transform("kids", lambda x: x["h"])})
    for i in range(DIGIT):
        below = F.col(f"l{i}")
        out = out.withColumn(f"l{i + 1}", F.when(F.col("lone") & (F.size(below) == 1), below).otherwise(_two_by_two(below)))
    levels = [f"l{i}" for i in range(DIGIT)]
    return out.select(*keys, F.get(f"l{DIGIT}", F.lit(0)).alias("h"), F.struct("lone", *levels, "kids").alias("node"))


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(key, block, h, node) from (key, rank, h, carried)."""
    digits = [f"d{i}" for i in range(DIGITS)]
    cols = {d: F.shiftright("rank", DIGIT * i).bitwiseAND((1 << DIGIT) - 1).cast("int") for i, d in enumerate(digits)}
    out = nodes.withColumns({"block": F.shiftright("rank", DIGIT * DIGITS), **cols})
    # Partitioned by block once; every further grouping keeps to that.
    out = out.select("key", "block", *digits, "h", *carried).repartition(_parts(nodes), "key", "block")
    for i, digit in enumerate(digits):
        out = _grouped_away(out, ["key", "block", *digits[:i:-1]], digit, carried if i == 0 else ["node"])
    return out


def _tiers(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Blocks of every tier, each written once; the last has one block per key."""
    tiers = [stored(_blocks(nodes, carried))]
    while (tiers[-1].agg(F.max("block")).first()[0] or 0) > 0:
        tiers.append(stored(_blocks(tiers[-1].select("key", F.col("block").alias("rank"), "h"), [])))
    return tiers


def _path(node: Column, digit: Column) -> Column:
    """Per level, from the children up: the sibling (null where the run has none) and whether it stands left."""
    steps = [F.struct(
        (~(node["lone"] & (F.size(node[f"l{i}"]) == 1))).alias("on"),
        F.get(node[f"l{i}"], F.shiftright(digit, i).bitwiseXOR(F.lit(1))).alias("sibling"),
        (F.shiftright(digit, i).bitwiseAND(F.lit(1)) == 1).alias("left")) for i in range(DIGIT)]
    return F.transform(F.filter(F.array(*steps), lambda s: s["on"]), lambda s: F.struct(s["sibling"].alias("sibling"), s["left"].alias("left")))


def _handed_down(tiers: list[DataFrame], tops: DataFrame | None, carried: list[str]) -> DataFrame:
    """(key, path, root, subroot, h, carried) per child of the lowest tier.

    ``tops`` (key, path, root, subroot) is what lies above each key's last block; None if nothing does.
    """
    nothing = F.array().cast("array<struct<sibling:string,left:boolean>>")
    if tops is None:
        above = tiers[-1].select("key", F.lit(0).cast("long").alias("block"), nothing.alias("path"), F.col("h").alias("root"), F.col("h").alias("subroot"))
    else:
        above = tops.withColumn("block", F.lit(0).cast("long"))
    for at, blocks in reversed(list(enumerate(tiers))):
        both = blocks.select("key", "block", "node").unionByName(above.select("key", "block", "path", "root", "subroot"), allowMissingColumns=True)
        found = both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("node", "path", "root", "subroot")])
        for i in range(DIGITS - 1, -1, -1):
            found = found.select("key", "block", "path", "root", "subroot", "node", F.explode("node.kids").alias("kid"))
            found = found.withColumns({
                "path": F.concat(_path(F.col("node"), F.col("kid.digit")), "path"),
                "block": F.shiftleft("block", DIGIT).bitwiseOR(F.col("kid.digit").cast("long"))})
            kept = [F.col("kid.h").alias("h"), *[F.col(f"kid.{c}").alias(c) for c in (carried if at == 0 else [])]] if i == 0 else [F.col("kid.node").alias("node")]
            found = found.select("key", "block", "path", "root", "subroot", *kept)
        above = found
    return above


def merkle_proofs(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """(h, subroot, root, path, carried) for every row of ``rows`` (key, h, carried).

    Leaves of one key follow ``order``, then the leaf. ``path`` lists siblings from the leaf to the root.
    """
    leaves = ranked(rows.select("key", *dict.fromkeys([*order, "h", *carried])), [*dict.fromkeys([*order, "h"])])
    tiers = _tiers(leaves.select("key", "rank", "h", *carried), carried)
    roots = tiers[-1].select(F.lit(0).alias("key"), F.col("key").alias("name"), "h")
    top_tiers = _tiers(ranked(roots, ["name"]).select("key", "rank", "h", "name"), ["name"])
    tops = _handed_down(top_tiers, None, ["name"]).select(F.col("name").alias("key"), "path", "root", F.col("h").alias("subroot"))
    return _handed_down(tiers, tops, carried).select("h", "subroot", "root", "path", *carried)


def proof_hash(path: Column) -> Column:
    """The hash of the siblings, level by level."""
    held = F.filter(path, lambda s: s["sibling"].isNotNull())
    return F.sha2(F.array_join(F.transform(held, lambda s: s["sibling"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(
        F.when(s["sibling"].isNull(), h).when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "lang", found: Column | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, path, found) for every row of ``docs``.

    ``found`` is the leaf that a later reading of a row gives, over the columns of ``docs``; null where it
    was not read again. It travels with the row, to be checked against the root by :func:`folded`.
    """
    leaf = leaf_hash(*[F.col(c) for c in fields])
    again = F.lit(None).cast("string") if found is None else found
    rows = docs.select(F.col(group).alias("key"), F.col(id).alias("id"), leaf.alias("h"), again.alias("found"))
    out = merkle_proofs(rows, ["id"], ["id", "found"])
    return out.select(F.col("id").alias(id), F.col("h").alias("leaf"), "subroot", "root", "path", "found")


def tampered_leaf(every: int = 7, id: str = "doc_id", count: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf with ``count`` raised by one where ``every`` divides the checksum of the id; else null."""
    more = F.col(count).cast("decimal(20,0)") + F.lit(1)
    picked = F.crc32(F.col(id).cast("string")) % every == 0
    return F.when(picked, leaf_hash(*[more if c == count else F.col(c) for c in fields]))


def verified_manifest(docs: DataFrame, every: int = 7, fields: tuple[str, ...] = FIELDS, id: str = "doc_id", group: str = "lang", count: str = "n_chars") -> DataFrame:
    """Every row's proof, and whether its leaf, tampered with or not, still leads to the root."""
    proved = manifest(docs, fields=fields, id=id, group=group, found=tampered_leaf(every, id, count, fields))
    out = proved.withColumn("folded_root", folded(F.coalesce("found", "leaf"), F.col("path")))
    return out.select(
        id, "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
