"""Byte-level BPE: encode by merge ranks and decode, with a hierarchical-bitmap rank queue.

The queue has one bucket per merge rank; one queue serves many pre-tokens at once. A bucket holds the positions of the left halves
of adjacent pairs with that rank; positions are nodes of a linked list over the bytes. Two bitmap levels
say which buckets hold something: find-first-set on the upper word, then on the lower one, gives the
lowest rank. Within a bucket positions come in rising order. A merge joins two nodes and queues the two
pairs it makes; entries it made stale stay in their buckets and are skipped when they come up, since a
position whose pair no longer has the bucket's rank is not merged. No step looks at the whole pre-token,
so very long ones cost little more a byte than short ones.

The text is cut by the pattern first and pre-tokens are encoded separately; special tokens have no
meaning. Workers keep the result of short pre-tokens they met (at most CACHE_ENTRIES, in two generations, of which
the older one goes when the newer is full), which changes speed only.

Null texts count as empty and give no tokens. Repeated rows each get their own result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import fresh

CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
#: Texts are encoded together up to this many characters; a longer one is encoded alone.
CHUNK_CHARS = 500_000
WORD_SHIFT = 8
WORD_MASK = (1 << WORD_SHIFT) - 1


class Vocabulary:
    """Byte strings by rank, as a rank file lists them."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    @functools.cached_property
    def byte_pairs(self) -> np.ndarray:
        """Rank of every two bytes, -1 where they don't merge."""
        table = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                table[token[0] << 8 | token[1]] = rank
        return table

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token; one queue serves them all, and nothing merges across them."""
        ranks = self.ranks
        got = ranks.get
        found = [None if (rank := got(p)) is None else (rank,) for p in pieces]
        open_ = [k for k, ids in enumerate(found) if ids is None and pieces[k]]
        if not open_:
            return [() if ids is None else ids for ids in found]
        data = b"".join(pieces[k] for k in open_)
        n = len(data)
        starts = np.zeros(len(open_) + 1, dtype=np.int64)
        np.cumsum([len(pieces[k]) for k in open_], out=starts[1:])
        first = bytearray(n + 1)  # 1 where a pre-token starts, and at the end
        np.frombuffer(first, dtype=np.uint8)[starts] = 1
        end = list(range(1, n + 1))  # of the node that starts at a position
        before = list(range(-1, n))

        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        by_rank = np.full(n, -1, dtype=np.int64)
        by_rank[:-1] = self.byte_pairs[raw[:-1] << 8 | raw[1:]]
        by_rank[starts[1:] - 1] = -1
        pair = by_rank.tolist()  # rank of a node and the next one
        order = np.argsort(by_rank, kind="stable")
        order = order[np.searchsorted(by_rank[order], 0):]
        levels, cuts = np.unique(by_rank[order], return_index=True)
        buckets = {int(r): part.tolist() for r, part in zip(levels, np.split(order, cuts[1:]))} if len(order) else {}
        words: dict[int, int] = {}
        top = 0
        for rank in buckets:
            word = rank >> WORD_SHIFT
            words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
            top |= 1 << word

        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = (word << WORD_SHIFT) + lowest.bit_length() - 1
            words[word] = bits = bits ^ lowest
            if not bits:
                top ^= 1 << word
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            for k, left in enumerate(bucket):
                if pair[left] != rank:
                    continue  # stale
                mid = end[left]
                stop = end[left] = end[mid]
                pair[mid] = -1
                low, made = rank, []
                if first[stop]:
                    pair[left] = -1
                else:
                    before[stop] = left
                    new = pair[left] = got(data[left:end[stop]], -1)
                    if new >= 0:
                        made.append((new, left))
                if not first[left]:
                    at = before[left]
                    new = pair[at] = got(data[at:stop], -1)
                    if new >= 0:
                        made.append((new, at))
                for new, at in made:
                    if new in buckets:
                        buckets[new].append(at)
                    else:
                        buckets[new] = [at]
                        word = new >> WORD_SHIFT
                        words[word] = words.get(word, 0) | 1 << (new & WORD_MASK)
                        top |= 1 << word
                    if new < low:
                        low = new
                if low < rank and k + 1 < len(bucket):  # a lower rank came up: the rest of the bucket waits
                    buckets[rank] = bucket[k + 1:]
                    word = rank >> WORD_SHIFT
                    words[word] |= 1 << (rank & WORD_MASK)
                    top |= 1 << word
                    break
        for j, k in enumerate(open_):
            ids, at, stop = [], int(starts[j]), int(starts[j + 1])
            while at < stop:
                ids.append(ranks[data[at:end[at]]])
                at = end[at]
            found[k] = tuple(ids)
        return [() if ids is None else ids for ids in found]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def _vocabulary(rank_file: bytes) -> Vocabulary:
    return Vocabulary(rank_file)


class Encoder:
    """A vocabulary, the pattern that cuts pre-tokens, and the worker's cache."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import regex

        self.vocabulary = _vocabulary(rank_file)
        self.cut = regex.compile(pattern).findall
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, texts) -> Iterator[list[int]]:
        """The ids of each text; a null text has none."""
        texts = ["" if x is None else x for x in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_CHARS):
                size += len(texts[to])
                to += 1
            cut = [self.cut(x) for x in texts[at:to]]
            known = self._known(set().union(*cut)).__getitem__
            for pieces in cut:
                ids: list[int] = []
                for found in map(known, pieces):
                    ids += found
                yield ids
            at = to

    def _known(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """A dictionary that has all of ``pieces``."""
        if len(self.recent) >= CACHE_ENTRIES // 2:
            self.older, self.recent = self.recent, {}
        missing = pieces - self.recent.keys()
        known = self.recent
        if any(len(p) > CACHE_CHARS for p in missing):
            known = dict(known)
        new = []
        for p in missing:
            found = self.older.get(p)
            if found is None:
                new.append(p)
            else:
                self.recent[p] = known[p] = found
        for p, ids in zip(new, self.vocabulary.encode([p.encode("utf-8") for p in new])):
            known[p] = ids
            if len(p) <= CACHE_CHARS:
                self.recent[p] = ids
        return known


@functools.cache
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    """The rank file; of bounded size, so it is sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "token_ids", keep: tuple[str, ...] | None = None,
    exact: str | None = None,
) -> DataFrame:
    """Columns ``keep`` (all others than ``ids`` by default) and ``ids``, the token ids of the text.

    With ``exact``, a column of that name says whether the decoded ids are the text's bytes.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(rank_file)
    keep = tuple(c for c in docs.columns if c not in (ids, exact)) if keep is None else keep
    source = fresh(docs, "__text")
    fields = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(exact, T.BooleanType())] if exact else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shipped.value, pattern)
        for batch in batches:
            out = batch[list(keep)].copy()
            same, lists = [], []
            for x, found in zip(batch[source], encoder.encode(batch[source])):
                lists.append(np.array(found, dtype=np.int32))
                if exact:
                    same.append(encoder.vocabulary.decode(found) == (x or "").encode("utf-8"))
            out[ids] = pd.Series(lists, dtype=object, index=out.index)
            if exact:
                out[exact] = same
            yield out

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(source)).mapInPandas(run, fields)


def decode_documents(encoded: DataFrame, rank_file: bytes, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; a null list counts as empty."""
    shipped = encoded.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        voc = _vocabulary(shipped.value)
        return pd.Series([b"" if x is None else voc.decode(x.tolist()) for x in column], dtype=object)

    return encoded.withColumn(into, decode(F.col(ids)))


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per document: encoded, then decoded from the ids.

    Token lists stay inside the task; documents that long lists would make large leave it as digests.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(rank_file)
    key, source = docs.schema[id], fresh(docs, "__text")
    fields = T.StructType([
        T.StructField(id, key.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shipped.value, pattern)
        names = {i: str(i) for i in encoder.vocabulary.tokens}
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch[source]):
                rows.append((
                    len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(encoder.vocabulary.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id, batch[id].to_numpy())
            yield out

    return docs.select(F.col(id), F.col(text).alias(source)).mapInPandas(run, fields)
