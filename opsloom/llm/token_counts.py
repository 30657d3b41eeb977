"""Token counts by heap-and-linked-list byte-pair merging: symbols minus merges, no ids."""
from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import splitter
from .common import in_arrow, slices


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter(dict):
    """Merges of a byte-level vocabulary file; as a dict it keeps the counts of pre-tokens."""

    def __init__(self, path: str, pattern: str, keep: int = 800_000) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, split = data["model"], data["pre_tokenizer"]
        for what, given, known in (("normalizer", data["normalizer"], None), ("kind", model["type"], "BPE"), ("splitter", split["type"], "ByteLevel"),
                                   ("prefix space", split["add_prefix_space"], False), ("dropout", model["dropout"], None)):
            if given != known:
                raise ValueError(f"{what} {given} is not supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.symbol = [0] * 256
        for letter, b in letters.items():
            self.symbol[b] = vocab[letter]
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        #: Left and right symbol -> rank << 20 | the symbol they make.
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.specials, self.special = specials, regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split, self.keep = splitter(pattern), keep

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        count = self.merged(raw)
        if len(self) >= self.keep:
            self.clear()
        if len(raw) < 256:
            self[piece] = count
        return count

    def merged(self, raw: bytes) -> int:
        """Symbols of one pre-token less its merges, the lowest rank first, from the left."""
        n, get = len(raw), self.merges.get
        symbols = [self.symbol[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rule >> 20) << 32 | i for i in range(n - 1) if (rule := get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            rule = get(symbols[i] << 20 | symbols[j])
            if rule is None or rule >> 20 != entry >> 32:
                continue  # an entry that a merge made stale
            merges += 1
            made = symbols[i] = rule & 0xFFFFF
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rule := get(made << 20 | symbols[k])) is not None:
                    heappush(heap, (rule >> 20) << 32 | i)
            h = before[i]
            if h >= 0 and (rule := get(symbols[h] << 20 | made)) is not None:
                heappush(heap, (rule >> 20) << 32 | h)
        return n - merges

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)
        return sum(map(self.__getitem__, self.split(text)))


_counters: dict[tuple[str, str], Counter] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` with the UTF-8 length and the token count of every whole text (null: empty, no tokens).

    A special string inside a text is one token, as the library has it by default. ``path`` must be
    readable on every executor. A given column with one of the added names is refused.
    """
    added = [T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())]
    clash = {c.lower() for c in docs.columns} & {f.name.lower() for f in added}
    if clash:
        raise ValueError(f"documents already have {sorted(clash)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counters.get((path, pattern)) or _counters.setdefault((path, pattern), Counter(path, pattern))
        for batch in slices(batches, text):
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            sizes = pa.array([len(x.encode()) if x else 0 for x in bodies], pa.int64())
            counts = pa.array([own.count(x) if x else 0 for x in bodies], pa.int64())
            yield pa.record_batch([*batch.columns, sizes, counts], [*batch.schema.names, n_bytes, n_tokens])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, *added]))
