"""Secret scan: fixed formats, and sliding windows of high Shannon entropy per character class.

Everything is a column expression; there is no shuffle. Positions count code points, ends are exclusive.

A window slides over each candidate (a maximal run of a class's characters, at least one window long).
The state of the slide is the count of every character in the window and the sum of c * log2(c) over
these counts; a step adds the character that enters and removes the one that leaves, so it touches two
counts. Entropy is log2(W) - sum / W. Sums are kept in whole units of 2**-20, so no rounding error
builds up along a long candidate. Windows that reach the class's threshold and overlap are one span.

The allow-list takes out what it names and nothing beside it. Placeholders and alphabets, and a digest
after its name, are cut out of a candidate; in the host and path of a web address, which is found first and
in whole, candidates end at slashes, so names of folders are not glued together wherever in it they stand. What is left on either side is searched on its own, unless it is
a UUID or a run of letters or digits only. User info, path segments and query values of addresses are
candidates like others. Only the payload of a data URI is passed over whole. Spans that a fixed format
already covers are not listed again; fixed formats are never suppressed.

Null texts count as empty and give no span. Repeated rows each get their own result. Other columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.binding import bind
from kerbline.llm.common import fresh, whole

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE_MIN = 6

UNIT = 1 << 20
BLOCK = 512
MASK = "[SECRET]"


@dataclass(frozen=True)
class CharacterClass:
    """Characters that form candidates, the window's length and the least entropy in bits."""

    kind: str
    characters: str
    pattern: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    CharacterClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.9),
)
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", *[c.kind for c in CLASSES])

#: Cut out of candidates wherever they stand.
PLACEHOLDER = r"(?i)0123456789|abcdefghijklmnop|example|xxxxxxxx"
#: What is left of a candidate is no secret if one of these matches.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]*$",
    PLACEHOLDER,
)
#: Nor is a candidate after a text that one of these matches.
ALLOW_BEFORE = (r"(?i);base64,$",)
#: After this the candidate's beginning is a digest, in hexadecimal or base64.
DIGEST_BEFORE = r"(?i)sha(1|256|384|512)[-:]$"
DIGEST = r"^(?:[0-9a-fA-F]{20,128}+(?![0-9A-Za-z+])|[A-Za-z0-9+/]{20,86}={0,2})"
#: Characters before a candidate that are kept; the patterns above that look at them are shorter.
BEFORE = 16
#: A web address: a scheme's last letter, and all up to the next blank. Its path ends where the second one's match does.
ADDRESS, PATH = r"[A-Za-z]://\S*", r"^[A-Za-z]://[^?#]*"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut by the pattern's matches: each gap, and the match after it (null after the last)."""
    cut = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(
            F.length(gap).cast("long").alias("gap"), F.coalesce(F.length(hit), F.lit(0)).cast("long").alias("len"),
            hit.alias("hit"), F.right(gap, F.lit(BEFORE)).alias("before")),
    )
    return F.when(text.rlike(pattern), cut).otherwise(F.array().cast("array<struct<gap:bigint,len:bigint,hit:string,before:string>>"))


_HIT = "struct<start:bigint,end:bigint,hit:string,before:string>"


def _in_block(pieces: Column) -> Column:
    """Hits with their positions from the block's start."""

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        hit = F.struct(start.alias("start"), (start + p["len"]).alias("end"), p["hit"].alias("hit"), p["before"].alias("before"))
        out = F.when(p["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(hit)))
        return F.struct((start + p["len"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_HIT}>").alias("out"))
    return F.aggregate(pieces, zero, add, lambda s: s["out"])


def _hits(pieces: Column) -> Column:
    """Hits with their positions; in blocks, so the work on a text with very many hits stays in proportion."""

    def of_blocks(blocks: Column) -> Column:
        ends = F.aggregate(
            blocks, F.array(F.lit(0).cast("long")),
            lambda ends, b: F.concat(ends, F.array(F.element_at(ends, -1) + F.aggregate(
                b, F.lit(0).cast("long"), lambda n, p: n + p["gap"] + p["len"]))),
        )
        return F.flatten(F.zip_with(
            F.transform(blocks, _in_block), F.slice(ends, F.lit(1), F.size(blocks)),
            lambda hits, at: F.transform(hits, lambda h: F.struct(
                (h["start"] + at).alias("start"), (h["end"] + at).alias("end"), h["hit"].alias("hit"), h["before"].alias("before"))),
        ))

    def cut(p: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        return bind(F.transform(firsts, lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return F.when(F.size(pieces) > 0, bind(pieces, cut)).otherwise(F.array().cast(f"array<{_HIT}>"))


def _spans(hits: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(order).alias("order"), h["end"].alias("end"), F.lit(kind).alias("kind")))


def _windows(candidate: Column, c: CharacterClass) -> Column:
    """(from, to) of every union of overlapping windows that reach the threshold, within a candidate."""
    w = c.window
    weight = [round(UNIT * n * math.log2(n)) if n else 0 for n in range(w + 2)]
    limit = math.floor(UNIT * w * (math.log2(w) - c.bits))
    weights = F.array(*[F.lit(x).cast("long") for x in weight])
    span = "struct<from:int,to:int>"

    def slide(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            # The entering character is counted first; where it equals the leaving one nothing changes.
            changed = enters != leaves
            n_in, n_out = F.get(s["counts"], enters), F.get(s["counts"], F.greatest(leaves, F.lit(0)))
            more = F.get(weights, n_in + 1) - F.get(weights, n_in)
            less = F.when(leaves < 0, F.lit(0).cast("long")).otherwise(F.get(weights, n_out - 1) - F.get(weights, n_out))
            total = F.when(changed, s["sum"] + more + less).otherwise(s["sum"])
            counts = F.when(changed, F.transform(
                s["counts"], lambda n, k: n + F.when(k == enters, 1).when(k == leaves, -1).otherwise(0))).otherwise(s["counts"])
            return bind(
                F.struct(total.alias("sum"), counts.alias("counts")),
                lambda now: merge(s, now, i),
            )

        def merge(s: Column, now: Column, i: Column) -> Column:
            high = (i >= w - 1) & (now["sum"] <= limit)
            apart = high & (s["to"] < i - w + 1)
            closed = F.when(apart & (s["to"] >= 0), F.concat(s["closed"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to")))))
            return F.struct(
                now["counts"].alias("counts"), now["sum"].alias("sum"),
                F.when(apart, i - w + 1).otherwise(s["from"]).alias("from"),
                F.when(high, i + 1).otherwise(s["to"]).alias("to"),
                closed.otherwise(s["closed"]).alias("closed"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(c.characters)).alias("counts"), F.lit(0).cast("long").alias("sum"),
            F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(f"array<{span}>").alias("closed"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), start, step,
            lambda s: F.when(s["to"] >= 0, F.concat(s["closed"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))).otherwise(s["closed"]),
        )

    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(c.characters), ch) - 1)
    return bind(codes, slide)


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    ok = F.lit(False)
    for p in patterns:
        ok = ok | text.rlike(p)
    return ok


def _cut(text: Column, pattern: str) -> Column:
    """(at, text) of what stands between the pattern's matches."""
    ends = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))

    def add(state: Column, p: Column) -> Column:
        return F.struct(
            (state["at"] + F.length(p["gap"]) + p["len"]).alias("at"),
            F.concat(state["out"], F.array(F.struct(state["at"].alias("at"), p["gap"].alias("text")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
    gaps = F.zip_with(F.split(text, pattern, -1), ends, lambda gap, n: F.struct(gap.alias("gap"), F.coalesce(n, F.lit(0)).alias("len")))
    return F.aggregate(gaps, zero, add, lambda s: s["out"])


def _addresses(hits: Column) -> Column:
    """(start, path_end, end) of the web addresses of a text, which have no blanks and so don't meet."""
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (h["start"] + F.length(F.regexp_extract(h["hit"], PATH, 0))).alias("path_end"), h["end"].alias("end")))


def _in_path(addresses: Column, at: Column) -> Column:
    """Whether a place is in the host or path of an address: the last one that starts before it, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(addresses) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        before = F.get(addresses, middle)["start"] + 1 < at
        open_ = s["lo"] < s["hi"]
        return F.struct(
            F.when(open_ & before, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~before, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(addresses).alias("hi"))
    last = F.aggregate(steps, start, halve, lambda s: F.get(addresses, s["lo"] - 1))
    return F.coalesce(at <= F.least(last["path_end"], last["end"] - 1), F.lit(False))


def _parts(hit: Column, addresses: Column, c: CharacterClass) -> Column:
    """(at, text) of the parts of a candidate that are searched."""
    text, digest = hit["hit"], hit["before"].rlike(DIGEST_BEFORE)
    path = _in_path(addresses, hit["start"])
    parts = F.when(digest, _cut(text, f"{PLACEHOLDER}|{DIGEST}")).when(path, _cut(text, f"{PLACEHOLDER}|/")).when(
        text.rlike(PLACEHOLDER), _cut(text, PLACEHOLDER)).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("text"))))
    return F.filter(parts, lambda p: (F.length(p["text"]) >= c.window) & ~_matches(p["text"], ALLOW))


def _entropy_spans(hits: Column, addresses: Column, c: CharacterClass) -> Column:
    order = KINDS.index(c.kind)
    parts = F.flatten(F.transform(
        F.filter(hits, lambda h: ~_matches(h["before"], ALLOW_BEFORE)),
        lambda h: F.transform(_parts(h, addresses, c), lambda p: F.struct((h["start"] + p["at"]).alias("start"), p["text"].alias("text")))))
    return F.flatten(F.transform(
        parts, lambda p: F.transform(_windows(p["text"], c), lambda s: F.struct(
            (p["start"] + s["from"]).alias("start"), F.lit(order).alias("order"), (p["start"] + s["to"]).alias("end"), F.lit(c.kind).alias("kind")))))


def _uncovered(spans: Column, by: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(by, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", base_into: str | None = None) -> DataFrame:
    """Add ``into``: array of (start, order, end, kind), sorted; ``base_into`` gets the fixed formats only."""
    names = {}
    work = docs
    for name in ("assign", "access", "hex", "address", *[c.kind for c in CLASSES]):
        names[name] = fresh(work, f"__{name}")
        pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "address": ADDRESS}.get(name) or next(c.pattern for c in CLASSES if c.kind == name)
        work = work.withColumn(names[name], _pieces(whole(text), pattern))
    work = work.withColumns({n: _hits(F.col(n)) for n in names.values()})
    work = work.withColumn(names["address"], _addresses(F.col(names["address"])))
    assign = F.filter(F.col(names["assign"]), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 2)) >= ASSIGN_VALUE_MIN)
    base = base_into or fresh(work, "__base")
    work = work.withColumn(base, F.array_sort(F.concat(
        _spans(assign, "assign"), _spans(F.col(names["access"]), "access"), _spans(F.col(names["hex"]), "hex"))))
    found = F.col(base)
    steps = []
    for c in CLASSES:
        steps.append(fresh(work, f"__with_{c.kind}"))
        more = _entropy_spans(F.col(names[c.kind]), F.col(names["address"]), c)
        work = work.withColumn(steps[-1], bind(found, lambda known: F.concat(known, _uncovered(more, known))))
        found = F.col(steps[-1])
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (into, base_into)]
    return work.select(*keep, F.array_sort(found).alias(into), *([F.col(base)] if base_into else []))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """Every document, with each secret (overlapping spans as one) replaced by ``mask``; null texts stay null."""
    spans = fresh(docs, "__secrets")
    work = scan_secrets(docs, text, spans)
    whole_text = F.col(text)

    def take(s: Column, x: Column) -> Column:
        gap = F.substring(whole_text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.lit(mask)))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    masked = F.aggregate(F.col(spans), zero, take, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(whole_text, (s["at"] + 1).cast("int"), F.length(whole_text))))
    return work.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(whole_text)).select(*[F.col(f"`{c}`") for c in docs.columns])
