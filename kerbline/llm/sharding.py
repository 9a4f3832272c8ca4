"""Sharding by histogram sort: equal bytes per shard, contiguous key ranges, one exchange.

The key is (hash of the text, hash of the id), so equal texts lie next to each other. Splitters are found
by counting: every round cuts the interval that holds a splitter's target into ``PROBES`` stretches,
counts the exact bytes below each probe in one aggregation, and goes on inside the stretch that holds the
target, narrowed to the least and greatest key in it. A splitter is done when a probe comes within
``tolerance`` of the mean shard. Where one text's copies straddle a target, the search goes on over the
hash of the id inside that text; where one row does, the nearer side is taken. What reaches the driver is
one row per probe, whatever the table's size.

Then the rows are exchanged once, by range of the key, sorted in their part and numbered there; rows per part
carry the numbers on and rows per shard set them back to 0, so slots follow the key in a shard of any size,
without gaps, and a text with many copies is spread over as many parts as it fills.

Null texts count as empty (size 1). Rows equal in id and text are parted by a running
number, so one row may be repeated as often as it likes. An empty table gives no rows; further columns
don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import stored, whole
from kerbline.llm.mixing import numbered_by_range

SHARDS = 8
PROBES = 64
TOLERANCE = 0.001
#: Bits of a key that part rows equal in id and text.
TIE_BITS = 20
_TOP = 1 << 63


@dataclass
class Search:
    """One splitter: bytes wanted below it, the interval it lies in, and bytes below that interval."""

    target: int
    below: int = 0
    lo: int = 0
    hi: int = _TOP
    text: int | None = None  # set while the search is inside the copies of one text
    found: tuple[int, int] | None = None

    @property
    def interval(self) -> tuple:
        return (self.text, self.lo, self.hi)

    def edge(self, key: int) -> tuple[int, int]:
        return (key, 0) if self.text is None else (self.text, key)

    def narrow(self, counted: list[tuple[int, int, int, int]], tolerance: float) -> None:
        """``counted``: (stretch, bytes, least key, greatest key), by stretch."""
        for _, size, least, greatest in counted:
            if self.below + size <= self.target:
                self.below += size
                continue
            before, after = self.target - self.below, self.below + size - self.target
            if min(before, after) <= tolerance or (least == greatest and self.text is not None):
                self.found = self.edge(least if before <= after else greatest + 1)
            elif least == greatest:
                self.text, self.lo, self.hi = least, 0, _TOP
            else:
                self.lo, self.hi = least, greatest + 1
            return
        self.found = self.edge(self.hi)  # the target lies behind all rows of the interval


def document_keys(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, crc, h, g): bytes and one, checksum, hashes of the text and of the id, below 2**63.

    The last ``TIE_BITS`` of ``g`` number the row, so that rows equal in id and text can be parted.
    """
    t = whole(text)
    ties = (1 << TIE_BITS) - 1
    named = F.shiftrightunsigned(F.xxhash64(F.lit("id"), F.col(id)), 1).bitwiseAND(~ties)
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(ties)
    return docs.select(
        F.col(id).alias("id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(t), 1).alias("h"), named.bitwiseOR(row).alias("g"))


def splitters(keys: DataFrame, total: int, shards: int, probes: int = PROBES, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The lower edges (h, g) of shards 1 and up."""
    searches = [Search(target=total * j // shards) for j in range(1, shards)]
    near = tolerance * total / shards
    while open_ := [s for s in searches if s.found is None]:
        intervals = list(dict.fromkeys(s.interval for s in open_))
        number = stretch = key = None
        for i, (text, lo, hi) in enumerate(intervals):
            at = F.col("h") if text is None else F.col("g")
            step = -(-(hi - lo) // probes)
            inside = (at >= lo) & (at <= hi - 1) if text is None else (F.col("h") == text) & (at >= lo) & (at <= hi - 1)
            cut = F.call_function("div", at - F.lit(lo), F.lit(step))
            number = F.when(inside, i) if number is None else number.when(inside, i)
            stretch = F.when(inside, cut) if stretch is None else stretch.when(inside, cut)
            key = F.when(inside, at) if key is None else key.when(inside, at)
        counted = (
            keys.select(number.alias("i"), stretch.alias("s"), key.alias("k"), "size").where(F.col("i").isNotNull())
            .groupBy("i", "s").agg(F.sum("size").alias("b"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
        for i, interval in enumerate(intervals):
            part = sorted((r["s"], r["b"], r["lo"], r["hi"]) for r in counted if r["i"] == i)
            for s in open_:
                if s.interval == interval and s.found is None:
                    s.narrow(part, near)
    return [s.found for s in searches]


def _not_below(edge: tuple[int, int]) -> Column:
    h, g = edge
    if h >= _TOP:
        return F.lit(False)
    later = F.col("h") > F.lit(h)
    same = F.col("h") == F.lit(h)
    return later | (same & (F.col("g") >= F.lit(g)) if g < _TOP else F.lit(False))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE,
) -> DataFrame:
    """(id, size, crc, shard, slot) for every row of ``docs``."""
    keys = stored(document_keys(docs, id, text))
    whole_table = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    edges = splitters(keys, whole_table["bytes"], shards, tolerance=tolerance) if whole_table["rows"] else []
    shard = F.lit(0)
    for edge in edges:
        shard = shard + _not_below(edge).cast("int")
    numbered = numbered_by_range(keys.withColumn("shard", shard), [F.col("h"), F.col("g"), F.col("id")])
    # A row per part, and one per shard: shards rise with the key, so the rows before one are those of the shards below.
    parts, of_shards = (numbered.groupBy(c).agg(F.count("*").alias("n")).select(
        c, F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_start"))
        for c in ("__part", "shard"))
    slot = F.col("__part_start") + F.col("__at") - F.col("shard_start")
    return numbered.join(parts, "__part").join(of_shards, "shard").select(
        F.col("id").alias(id), "size", "crc", "shard", slot.cast("long").alias("slot"))
