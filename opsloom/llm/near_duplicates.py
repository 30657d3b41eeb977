"""Near-duplicate classes: ProbMinHash signatures of weighted word shingles, banding, exact verification."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, in_arrow, slices, stored, words
from .components import components

MIX_A, MIX_B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(found: list[bytes], size: int) -> np.ndarray:
    """A 64-bit number per run of ``size`` words; a shorter text is one run, a text without words has none."""
    n = min(size, len(found))
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(31) + one[i:len(found) - n + 1 + i])
    return out


def signatures(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """ProbMinHash signatures, one row per text: ``starts`` cuts the flat arrays into texts of one shingle or more.

    Every shingle sends arrivals of a Poisson process whose rate is its weight; each arrival falls on a random
    component, which keeps the shingle that came first. Two texts agree in a component with the probability
    Jaccard similarity of their weights. A shingle ends as soon as its next arrival is later than the last
    first arrival over all components of its text: it cannot win any more.
    """
    n = len(starts) - 1
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint64)
    text = np.repeat(np.arange(n), np.diff(starts))
    time, state = np.zeros(len(shingles)), shingles
    step = 0
    while len(text):
        step += 1
        state = mixed(state + np.uint64(STEP * step % (1 << 64)))
        time = time - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / weights
        slot = text * size + (mixed(state ^ MIX_B) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = shingles[won]
        live = time < first.reshape(n, size).max(1)[text]
        text, time, state, weights, shingles = text[live], time[live], state[live], weights[live], shingles[live]
    return winner.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of equally many components, distinct between bands."""
    n, size = signature.shape
    parts = signature.reshape(n, bands, size // bands)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(size // bands):
        key = mixed(key * np.uint64(31) + parts[:, :, i])
    return key


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common shingles d of 1 / sum over all e of max(a_e / a_d, b_e / b_d); 1 for equal weights.

    ``a`` and ``b`` are sorted and distinct. With all weights 1 it is the plain Jaccard similarity. Each term
    needs the sum of a over shingles whose a / b is at least that of d, and of b over the others, so the
    common shingles are taken by the few distinct ratios.
    """
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[at_a].astype(float), wb[at_b].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratios, which = np.unique(x / y, return_inverse=True)
    sum_a, sum_b = (np.bincount(which, w, len(ratios)) for w in (x, y))
    from_a = only_a + np.cumsum(sum_a[::-1])[::-1]  # shingles of this ratio or above, and those of a alone
    from_b = only_b + np.cumsum(sum_b) - sum_b  # shingles below this ratio, and those of b alone
    # With r = a_d / b_d the term is 1 / (from_a / a_d + from_b / b_d) = a_d / (from_a + r from_b).
    return float((sum_a / (from_a + ratios * from_b)).sum())


def word_digest(found: list[bytes]) -> bytes | None:
    return blake2b(b" ".join(found), digest_size=16).digest() if found else None


def _sketch(docs: DataFrame, doc: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, key, bands`` of every row: a digest of the words in order, and the band keys (null without words)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids, keys, flat, weights, starts, at = batch.column(0), [], [], [], [0], []
            for i, body in enumerate(as_bytes(batch.column(1))):
                found = words(body)
                keys.append(word_digest(found))
                if found:
                    one, count = np.unique(shingle_hashes(found, shingle), return_counts=True)
                    flat.append(one)
                    weights.append(count)
                    starts.append(starts[-1] + len(one))
                    at.append(i)
            found_bands: list = [None] * len(keys)
            if at:
                made = band_keys(signatures(np.concatenate(flat), np.concatenate(weights).astype(float), np.array(starts), bands * rows), bands)
                for i, row in zip(at, made.view(np.int64), strict=True):
                    found_bands[i] = row
            yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(found_bands, pa.list_(pa.int64()))], ["id", "key", "bands"])

    return in_arrow(docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, key binary, bands array<bigint>")


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, key, weighted``: the sorted distinct shingles of a text, packed, and their counts where one is above 1."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out, keys = [], []
            for body in as_bytes(batch.column(1)):
                found = words(body)
                one, count = np.unique(shingle_hashes(found, shingle), return_counts=True)
                keys.append(word_digest(found))
                out.append(pack(one, count))
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["id", "key", "weighted"])

    return in_arrow(texts.select("id", "text"), run, "id long, key binary, weighted binary")


def pack(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    head = np.array([len(shingles)], "<u8").tobytes() + shingles.astype("<u8").tobytes()
    return head + counts.astype("<u4").tobytes() if (counts > 1).any() else head


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Shingles and counts; no counts if all are 1."""
    n = int(np.frombuffer(packed, "<u8", 1)[0])
    return np.frombuffer(packed, "<u8", n, 8), np.frombuffer(packed, "<u4", n, 8 + 8 * n) if len(packed) > 8 + 8 * n else None


def similarity(x: bytes, y: bytes) -> float:
    (a, wa), (b, wb) = unpack(x), unpack(y)
    if wa is None and wb is None:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) if both else 0.0
    return probability_jaccard(a, np.ones(len(a)) if wa is None else wa, b, np.ones(len(b)) if wb is None else wb)


#: Pairs whose shingles a task unpacks at a time.
PAIRS = 256


def _verified(pairs: DataFrame, weighted: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose probability Jaccard similarity is ``least`` or more."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                x, y = (as_bytes(batch.column(i)) for i in (2, 3))
                keep = [similarity(p, q) >= least for p, q in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = weighted.select(F.col("id").alias("a"), F.col("weighted").alias("x"))
    right = weighted.select(F.col("id").alias("b"), F.col("weighted").alias("y"))
    return in_arrow(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


#: Members and bytes of shingles in a block of a hub's group.
BLOCK_MEMBERS, BLOCK_BYTES, COLUMNS = 512, 4 << 20, 2048


def _between(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between members of two blocks of one group (or within one block) whose components differ.

    Common shingles of all pairs are counted by products of 0/1 matrices, a few thousand shingles at a time.
    For texts that repeat no shingle this gives the similarity itself. For others the smaller sum of the
    common shingles' shares bounds it from above, and the pairs that are left are taken one by one. Of
    the links only those that join something new are returned, fewer than there are members.
    """
    first, second = group["i"].iloc[0], group["j"].iloc[0]
    group = group.drop_duplicates("id").reset_index(drop=True)
    ids, parts, blobs = group["id"].to_numpy(), group["c"].to_numpy(), group["weighted"].tolist()
    rows, columns = np.flatnonzero(group["block"] == first), np.flatnonzero(group["block"] == second)
    sets = [unpack(b) for b in blobs]
    sizes = np.array([len(a) for a, _ in sets], float)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, which, seen = np.unique(np.concatenate([a for a, _ in sets]), return_inverse=True, return_counts=True)
    flat = np.array([w is None for _, w in sets])
    share = np.concatenate([np.full(len(a), 1 / len(a)) if w is None else w / w.sum() for a, w in sets])
    place = np.cumsum(seen > 1) - 1
    common = np.flatnonzero(seen[which] > 1)
    common = common[np.argsort(place[which[common]], kind="stable")]
    at = place[which[common]]
    both = np.zeros((len(rows), len(columns)), np.float32)
    shares = None if flat.all() else (np.zeros_like(both), np.zeros_like(both))
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        lo, hi = np.searchsorted(at, [start, start + COLUMNS])
        here, one = common[lo:hi], np.zeros((len(sets), COLUMNS), np.float32)
        one[owner[here], at[lo:hi] - start] = 1
        both += one[rows] @ one[columns].T
        if shares:
            part = np.zeros_like(one)
            part[owner[here], at[lo:hi] - start] = share[here]
            shares[0][:] += part[rows] @ one[columns].T
            shares[1][:] += one[rows] @ part[columns].T
    differ = parts[rows][:, None] != parts[columns][None]
    if first == second:
        differ &= rows[:, None] < columns[None]
    exact = both.astype(float) / (sizes[rows][:, None] + sizes[columns][None] - both) >= least
    if shares:
        plain = flat[rows][:, None] & flat[columns][None]
        linked = differ & plain & exact
        for x, y in np.argwhere(differ & ~plain & (np.minimum(*shares) >= least - 1e-3)):
            linked[x, y] = similarity(blobs[rows[x]], blobs[columns[y]]) >= least
    else:
        linked = differ & exact
    root = {p: p for p in parts.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    out = []
    for x, y in np.argwhere(linked):
        p, q = find(parts[rows[x]].item()), find(parts[columns[y]].item())
        if p != q:
            root[p] = q
            out.append((min(ids[rows[x]], ids[columns[y]]), max(ids[rows[x]], ids[columns[y]])))
    return pd.DataFrame(out, columns=["a", "b"])


def _loose_links(shared: DataFrame, group: DataFrame, weighted: DataFrame, least: float) -> DataFrame:
    """Links between members of one hub's buckets that are in different components so far."""
    placed = shared.select("hub", "id").distinct().join(group, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("c"))
    unsettled = placed.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("hub")
    members = stored(placed.join(unsettled, "hub", "left_semi"), "loose")
    sized = weighted.select("id", F.length("weighted").alias("n"))
    load = members.join(sized, "id").groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_BYTES)).alias("blocks"))
    dealt = members.join(load, "hub").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("hub", "id", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = dealt.join(weighted, "id").groupBy("hub", "i", "j")
    return met.applyInPandas(lambda rows: _between(rows, least), "a long, b long")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """``id, class_id`` for every row: near duplicates share a class, named by its smallest id.

    Words are runs of ASCII letters and digits (lower-cased) and of all characters above ASCII. Shingles are
    runs of ``shingle`` words weighted by their count in the text; a shorter text is one shingle. Texts with
    equal words in order are one class at once. Distinct texts are linked if the probability Jaccard
    similarity of their shingles is ``least`` or more and they agree in a band of their ProbMinHash signature
    (``bands`` of ``rows`` components: a pair at 0.8 is missed three times in 100,000). Classes are the
    connected components of the links.

    A null or empty text, or one without words, is alike to none: its class is its own id. A null id stands
    for a class of its own (null) and links nothing. Rows with equal ids are one document, judged by the text
    of the smallest digest.

    No bucket makes all its pairs. In each band bucket every member meets one hub, the member that shares
    most buckets with others, which is the middle of a group of copies. What is left is exact too: members of one
    hub's buckets whose components still differ are compared in blocks, inside tasks that return only the
    links that join something, and components are taken again.
    """
    sketch = stored(_sketch(docs, doc, text, shingle, bands, rows), "sketch")
    one = sketch.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("key", "bands"), "key").alias("t")).select("id", "t.key", "t.bands")
    distinct = stored(one.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "distinct")
    member = distinct.select(F.col("rep").alias("id"), "key", F.explode("bands").alias("band"))
    filled = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    meeting = stored(member.join(filled, "band"), "buckets")
    standing = meeting.join(meeting.groupBy("id").agg(F.sum("n").alias("met")), "id")
    hub = standing.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("m"), F.col("id"))).alias("h")).select("band", F.col("h.id").alias("hub"))
    shared = stored(meeting.join(hub, "band").select("band", "id", "key", "hub"), "hubs")
    stars = stored(shared.filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "stars")
    texts = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = shared.select("id", "key").distinct()
    own = _shingles(texts.join(wanted.select("id").hint("merge"), "id", "left_semi"), shingle).join(wanted, ["id", "key"], "left_semi")
    weighted = stored(own.dropDuplicates(["id"]).drop("key"), "weighted")
    links = stored(_verified(stars, weighted, least), "links")
    group = components(links)
    more = _loose_links(shared, group, weighted, least)
    copies = one.select("id", "key").join(distinct.select("key", "rep"), "key").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = components(stored(links.union(more).union(copies), "all-links")).withColumnRenamed("component", "class_id")
    return sketch.select("id").join(final.withColumnRenamed("component", "class_id"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def first_of_class(docs: DataFrame, classes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names its class, one document of each; rows without an id stay."""
    gone = classes.filter("class_id <> id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc].cast("long") == F.col("__gone"), "left_anti")
