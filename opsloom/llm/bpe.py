"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding."""
from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, in_arrow, slices

#: Same matches as the given pattern for texts below U+0250, by a faster matcher.
LETTERS, DIGITS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
LOW = re.compile(f" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
HIGH = re.compile("[^\x00-ɏ]")


def splitter(pattern: str):
    """The function that lists the matches of ``pattern`` in a text.

    For the usual pattern (letters, digits, others, blanks) texts without characters from U+0250 on go to ``LOW``.
    """
    import public_tokenizers

    full = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return full.findall
    return lambda text: full.findall(text) if HIGH.search(text) else LOW.findall(text)


BIT = [1 << i for i in range(256)]
#: Pre-tokens of more bytes are merged one by one: many equal pairs in one word would make the shared queue quadratic.
LONG = 48


class Codec(dict):
    """Ranks of a vocabulary file; as a dict it keeps the ids of pre-tokens as packed little-endian numbers.

    Merging repeats: the lowest rank of an adjacent pair first, from the left, until no pair has a rank.
    The queue of waiting pairs is a hierarchical bitmap over the ranks: a bit per rank says whether its bucket
    holds positions, a bit per 256 ranks says whether any of those is set, so two find-first-set steps give
    the lowest rank, however many pairs wait. The parts of the text are a linked list by their start. Entries
    that a merge made stale stay in their bucket and are skipped.
    """

    def __init__(self, path: str, pattern: str, keep: int = 250_000) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("the rank queue has two levels of 256")
        self.longest = max(map(len, self.ranks))
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split, self.keep = splitter(pattern), keep
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        #: Left and right id of each pair that has a rank, in order, and the ranks; the last entry is never found.
        self.pairs = np.array([*sorted(pairs), 1 << 40], np.int64)
        self.pair_ranks = np.array([*map(pairs.get, sorted(pairs)), -1], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pre-tokens into the memory."""
        ranks, short = self.ranks, []
        for piece in pieces:
            raw = piece.encode()
            rank = ranks.get(raw)
            if rank is not None:
                self[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self[piece] = self.merged_long(raw)
            else:
                short.append((piece, raw))
        if short:
            self.update(zip([p for p, _ in short], self.merged_many([r for _, r in short]), strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where it has none."""
        key = left << 16 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)

    def merged_many(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of short pre-tokens, which share one queue.

        Pre-tokens do not touch each other, so the lowest rank that waits anywhere is next for its own
        pre-token too. A step takes that rank's bucket and merges the first place in each pre-token; further
        places wait, because the merge may have made a pair of lower rank.
        """
        lengths = np.array([len(r) for r in raws])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = int(starts[-1])
        ids = np.append(self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)], 0)
        owner = np.repeat(np.arange(len(raws)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts[1:] - 1] = n  # n: no part
        before[starts[:-1]] = n
        before = np.append(before, n)
        inner = np.flatnonzero(after < n)
        wanted = np.full(n + 1, -1, np.int64)  # rank under which the pair that begins here waits
        wanted[inner] = self.rank_of(ids[inner], ids[inner + 1])
        waiting = inner[wanted[inner] >= 0]
        waiting = waiting[np.argsort(wanted[waiting], kind="stable")]
        found, cuts = np.unique(wanted[waiting], return_index=True)
        buckets = {rank: part.tolist() for rank, part in zip(found.tolist(), np.split(waiting, cuts[1:]), strict=True)} if len(waiting) else {}
        summary, words = 0, {}
        for rank in buckets:
            words[rank >> 8] = words.get(rank >> 8, 0) | BIT[rank & 255]
            summary |= BIT[rank >> 8]
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            at = np.array(buckets.pop(rank))
            words[high] = word ^ low
            if word == low:
                summary ^= BIT[high]
            at = at[wanted[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                first = np.append(True, owner[at[1:]] != owner[at[:-1]])
                rest, at = at[~first].tolist(), at[first]
            else:
                rest = []
            if not len(at):
                continue
            middle = after[at]
            end = after[middle]
            wanted[middle] = -1
            ids[middle] = -1
            ids[at] = rank
            after[at] = end
            before[end] = at  # at n: never read
            right = np.where(end < n, self.rank_of(np.full(len(at), rank), ids[end]), -1)
            wanted[at] = right
            left_at = before[at]
            left = np.where(left_at < n, self.rank_of(ids[left_at], np.full(len(at), rank)), -1)
            moved = left != wanted[left_at]
            wanted[left_at] = left
            wanted[n] = -1
            keep_right, keep_left = right >= 0, moved & (left >= 0)
            news = zip([*right[keep_right].tolist(), *left[keep_left].tolist(), *[rank] * len(rest)], [*at[keep_right].tolist(), *left_at[keep_left].tolist(), *rest], strict=True)
            for new, place in news:
                if new in buckets:
                    buckets[new].append(place)
                else:
                    buckets[new] = [place]
                    high = new >> 8
                    words[high] = words.get(high, 0) | BIT[new & 255]
                    summary |= BIT[high]
        alive = ids[:n] >= 0
        packed = ids[:n][alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive)[starts[1:] - 1] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merged_long(self, raw: bytes) -> bytes:
        """Packed ids of one pre-token of any length, position by position.

        The queue of waiting pairs is a hierarchical bitmap over the ranks: a bit per rank says whether its
        bucket holds positions, a bit per 256 ranks says whether any of those is set. Two find-first-set
        steps give the lowest rank, however many pairs wait. Parts of the text are a linked list by start.
        Entries that a merge made stale stay in their bucket and are skipped.
        """
        n, get, longest, ranks = len(raw), self.ranks.get, self.longest, self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i: its end, and the part before
        wanted = [-1] * n  # rank under which the pair that begins at i waits
        summary, words, buckets = 0, {}, {}
        for i in range(n - 1):
            rank = get(raw[i:i + 2])
            if rank is not None:
                wanted[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    high = rank >> 8
                    if high in words:
                        words[high] |= BIT[rank & 255]
                    else:
                        words[high] = BIT[rank & 255]
                        summary |= BIT[high]
        while summary:
            high = (summary & -summary).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                if word == low:
                    del words[high]
                    summary &= summary - 1
                else:
                    words[high] = word ^ low
            if wanted[i] != rank:
                continue
            middle = ends[i]
            wanted[middle] = wanted[i] = -1
            end = ends[i] = ends[middle]
            fresh = []
            if end < n:
                before[end] = i
                stop = ends[end]
                if stop - i <= longest and (new := get(raw[i:stop])) is not None:
                    wanted[i] = new
                    fresh.append((new, i))
            j = before[i]
            if j >= 0:
                new = get(raw[j:end])
                if new is None:
                    wanted[j] = -1
                elif wanted[j] != new:
                    wanted[j] = new
                    fresh.append((new, j))
            for new, at in fresh:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    high = new >> 8
                    if high in words:
                        words[high] |= BIT[new & 255]
                    else:
                        words[high] = BIT[new & 255]
                        summary |= BIT[high]
        out, i = [], 0
        while i < n:
            end = ends[i]
            out.append(ranks[raw[i:end]])
            i = end
        return np.array(out, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(x) if x else () for x in texts]
        new = set().union(*split).difference(self)
        if len(self) + len(new) > self.keep:
            self.clear()
            new = set().union(*split)
        self.learn(new)
        return [b"".join(map(self.__getitem__, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; its memory of pre-tokens is bounded."""
    return _codecs.get((path, pattern)) or _codecs.setdefault((path, pattern), Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, packed as little-endian unsigned 32-bit numbers, and their count.

    ``path`` must be readable on every executor. Each match of ``pattern`` is encoded by itself, without
    special tokens. Null counts as the empty text, which has no ids. With ``decoded`` that column gets the
    bytes which ``decode`` makes of the ids, in the same pass. A given column with one of these names is refused.
    """
    added = [T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    clash = {c.lower() for c in docs.columns} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"documents already have {sorted(clash)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text, 4 << 20):
            packed = own.encode_all(batch.column(batch.schema.get_field_index(text)).to_pylist())
            out = [pa.array([len(x) >> 2 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decoded:
                out.append(pa.array(map(own.decode, packed), pa.binary()))
            yield pa.record_batch([*batch.columns, *out], [*batch.schema.names, *[f.name for f in added]])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, *added]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that packed ids stand for (null: none). A given column of that name is refused."""
    if decoded.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows already have {decoded}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            packed = as_bytes(batch.column(batch.schema.get_field_index(ids)))
            out = pa.array((own.decode(x or b"") for x in packed), pa.binary())
            yield pa.record_batch([*batch.columns, out], [*batch.schema.names, decoded])

    return in_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())]))
