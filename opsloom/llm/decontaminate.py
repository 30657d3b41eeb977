"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, one pass over the documents."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, as_bytes, in_arrow, slices, stored, words

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

#: Automata of this worker by the identity of their block of windows.
_automata: dict[str, ahocorasick.Automaton] = {}


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """Distinct windows of ``size`` words with the items that hold them: ``window, n_words, items``.

    A shorter item is one window; null texts and texts without words have none. An item without an id
    gives windows that hit but no name to ``items``.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, names, lengths = batch.column(0).to_pylist(), [], [], []
            for name, body in zip(ids, as_bytes(batch.column(1)), strict=True):
                found = words(body)
                n = min(size, len(found))
                for i in range(len(found) - n + 1 if n else 0):
                    out.append(b" ".join(found[i:i + n]).decode())
                    names.append(name)
                    lengths.append(n)
            yield pa.record_batch([pa.array(out, pa.string()), pa.array(lengths, pa.int32()), pa.array(names, pa.string())], ["window", "n_words", "item"])

    found = in_arrow(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")), cut, "window string, n_words int, item string")
    return found.groupBy("window", "n_words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(key: str, rows: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    if key not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for window, n, items in rows:
            machine.add_word(f" {window} ", (n, tuple(items)))
        machine.make_automaton()
        _automata[key] = machine
    return _automata[key]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(machine: ahocorasick.Automaton, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words (first, past the last) and the items they come from."""
    line = f" {b' '.join(found).decode()} "
    ends = list(machine.iter(line)) if found and len(machine) else []
    if not ends:
        return [], set()
    gaps = [i for i, c in enumerate(line) if c == " "]
    runs, items = [], set()
    for end, (n, names) in ends:
        last = bisect_left(gaps, end)
        runs.append((last - n, last))
        items.update(names)
    return _merged(runs), items


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10,
                  block_bytes: int = 32 << 20, names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans")) -> DataFrame:
    """``docs`` with the words, the words inside windows of the benchmark, the items and the hit spans.

    ``names`` are the added columns: count of words, count of hit words, sorted item ids, and spans of hit
    runs as code point offsets (end exclusive) in the text as it was given. A null or empty text has no
    words. Rows are judged one by one, so repeated rows and ids get equal results; a given column with one
    of the ``names`` is refused.

    The windows of the benchmark are dealt by hash into blocks of about ``block_bytes``; one block makes one
    automaton, broadcast to the tasks, and one pass over the documents. Within a block nothing is
    shuffled. Further blocks (a benchmark of hundreds of MB) each add a pass, stored in between.
    """
    clash = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"documents already have {sorted(clash)}")
    windows = stored(item_windows(benchmark, item, item_text, size), "windows")
    weight = F.length("window") + F.lit(16) + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 1), F.lit(0))
    total = windows.agg(F.sum(weight).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out, given = docs, docs.columns
    for k in range(blocks):
        rows = [tuple(r) for r in windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select("window", "n_words", "items").toLocalIterator()]
        out = _scan(out, rows, text, names, first=k == 0)
        if k + 1 < blocks:
            out = stored(out, "contamination")
    return out.select(*[F.col(f"`{c}`") for c in given], *[F.col(f"`{n}`") for n in names])


def _scan(docs: DataFrame, rows: list, text: str, names: tuple[str, ...], first: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{sent._jbroadcast.id()}"
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(SPAN)), strict=True)]])
    n_words, _, items_name, spans_name = names

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(key, sent.value)
        for batch in slices(batches, text):
            bodies = as_bytes(batch.column(batch.schema.get_field_index(text)))
            before = None if first else [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (items_name, spans_name)]
            counts, hits, item_lists, span_lists = [], [], [], []
            for i, body in enumerate(bodies):
                found = words(body)
                runs, items = _hits(machine, found)
                spans: list[tuple[int, int]] = []
                if runs or before and before[1][i]:
                    at = [m.span() for m in WORD.finditer(body.decode())]
                    if before and before[1][i]:
                        first_at = {a: j for j, (a, _) in enumerate(at)}
                        last_at = {b: j for j, (_, b) in enumerate(at)}
                        runs = _merged([*runs, *((first_at[s["start"]], last_at[s["end"]] + 1) for s in before[1][i])])
                        items |= set(before[0][i])
                    spans = [(at[a][0], at[b - 1][1]) for a, b in runs]
                counts.append(len(found))
                hits.append(sum(b - a for a, b in runs))
                item_lists.append(sorted(items))
                span_lists.append([{"start": a, "end": b} for a, b in spans])
            added = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(item_lists, pa.list_(pa.string())), pa.array(span_lists, ARROW_SPAN)]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.record_batch([*own, *added], [f.name for f in kept] + list(names))

    return in_arrow(docs, scan, schema)
