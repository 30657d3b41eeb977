"""Operators that compare rows, and the pipeline, against brute force."""
import base64
import hashlib
import io
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsloom.llm import components, line_dedup, near_duplicates, nearest, warc
from opsloom.llm.common import shared_folder

DOCS = "doc_id long, text string, key string, band long"


def classes_by_hand(rows, least=0.8, size=5):
    sets = {}
    for d, t in rows:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        n = min(size, len(w))
        if d is not None and n:
            sets[d] = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if not x.keys() & y.keys():
                continue
            every = set(x) | set(y)
            j = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x if d in y)
            if j >= least - 1e-12:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def changed(words, n):
    out = list(words)
    for i in random.sample(range(len(out)), n):
        out[i] = f"z{random.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("members", [512, 6])
def test_near_duplicates_equal_brute_force(spark, members, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", members)
    rows, base = [(0, None), (1, ""), (2, "?!"), (3, "one two"), (4, "One, two!"), (5, "same same same same same same"), (6, "same same same same same same same")], []
    for _ in range(4):
        base.append([f"w{random.randint(0, 5000)}" for _ in range(random.choice((60, 150)))])
    repeated = [random.choice("abcd") for _ in range(200)]
    for i in range(100):
        w = changed(random.choice(base), random.randint(0, 4))
        rows.append((10 + i, " ".join(w)))
    for i in range(25):
        rows.append((200 + i, " ".join(changed(repeated, random.randint(0, 3)))))
    rows += [(300 + i, " ".join(base[0]).upper()) for i in range(5)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows] + [(None, rows[-1][1], "k", 1)], DOCS)
    got = near_duplicates.near_duplicates(docs)
    found = [(r.id, r.class_id) for r in got.collect()]
    assert len(found) == len(rows) + 1 and (None, None) in found
    assert {d: c for d, c in found if d is not None} == classes_by_hand(rows)
    kept = near_duplicates.first_of_class(docs, got)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in found} - {None})


def test_near_duplicates_of_nothing_and_of_repeated_ids(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_duplicates.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(7, "a b c d e f", "", 0), (7, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (7, "x y z x y z", "", 0)], DOCS)
    assert {r.id for r in near_duplicates.near_duplicates(one).collect()} == {7, 3}


def test_signature_agreement_estimates_the_similarity():
    random_ = np.random.default_rng(0)
    a = np.unique(random_.integers(1, 1 << 60, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:220], random_.integers(1, 1 << 60, 60).astype(np.uint64)]))
    wa, wb = random_.integers(1, 4, len(a)), random_.integers(1, 4, len(b))
    size = 4096
    s = near_duplicates.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), np.array([0, len(a), len(a) + len(b)]), size)
    assert abs((s[0] == s[1]).mean() - near_duplicates.probability_jaccard(a, wa, b, wb)) < 0.04
    assert near_duplicates.probability_jaccard(a, wa, a, wa) == pytest.approx(1)


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_hand(rows, chars=40, docs=5):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(small)
    seen = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).update({d} - {None})
    gone = {k: max(v) for k, v in seen.items() if len(k) >= chars and len(v) >= docs}
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if d is None or key(x) not in gone or gone[key(x)] == d]
        out.append((d, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fan_in"), [(4, 2), (1, 2), (6, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fan_in):
    random.seed(6)
    pool = ["é" * 39, "é" * 40, "\x0b Shared Line " + "x" * 40, "shared line " + "X" * 40 + "\r", "short", "", "É" * 41, "unit\x1f" + "y" * 50] + [f"line {i} " + "l" * 40 for i in range(12)]
    rows = [(None, None), (None, pool[2] + "\n" + pool[9]), (500, ""), (501, "\n\n"), (502, "q" * 200_000)]
    rows += [(i, "\n".join(random.choices(pool, k=random.randint(1, 6)) + [f"own {i} " + "o" * 40])) for i in range(60)]
    rows.append(rows[-1])
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], DOCS)
    got = line_dedup.dedup_lines(docs, batches=batches, fan_in=fan_in)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs.withColumnRenamed("key", "N_LINES"))


def test_line_dedup_counts_documents_and_stands_its_own_names(spark):
    line = "the same line of fifty characters, more or less ok"
    docs = spark.createDataFrame([(7, line)] * 4 + [(3, line)] + [(None, line)] * 3, "doc_id long, text string").withColumn("__doc", F.lit("x")).withColumn("__drop", F.lit("y"))
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == 8 and all(r.text == line and r.n_dropped == 0 and (r["__doc"], r["__drop"]) == ("x", "y") for r in got)
    more = docs.unionByName(spark.createDataFrame([(i, line, "x", "y") for i in (1, 2, 9)], docs.schema))
    kept = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(more).collect()}
    assert kept == {(None, line), (9, line), (1, ""), (2, ""), (3, ""), (7, "")}


def test_archives_give_urls_back_as_they_were(spark):
    urls = ["http://a/x  y\tz", None, "", " http://b ", "c\r\nX-Url: 1", 'q"\\u0020é']
    pages = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    made = warc.write_archives(pages, shared_folder(spark, "test-urls"))
    assert [r.url for r in warc.read_archives(made).orderBy("page_id").collect()] == urls


PAGES = "page_id long, url string, html string, path string"


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "c", None), (4, "d", ""), (5, "e", "x" * 300_000), (6, "f\r\nX: y", "<p>é</p>"), (6, "f", "<p>é</p>"), (None, "g", "<p>é</p>"), (8, "h", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "p") for r in rows], PAGES).repartition(3)
    folder = shared_folder(spark, "test-archives")
    made = warc.write_archives(pages, folder, archive_bytes=100, zip64=True)
    got = warc.read_archives(made).collect()
    assert len(got) == len(rows) and made.agg(F.sum("records")).first()[0] == len(rows)
    payload = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = payload[r.page_id]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        refers = {1: 6, 2: 6, 3: 4}.get(r.page_id)
        assert (r.record_type, r.refers_to, bytes(r.payload)) == (("revisit", refers, b"") if refers else ("response", None, body))
    assert {r.page_id for r in warc.read_archives(warc.write_archives(pages, folder, least_bytes=9)).filter("record_type = 'revisit'").collect()} == {1, 2}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_decide_each_payload_of_an_id(spark):
    rows = [(6, "A"), (6, "B"), (9, "B"), (4, "A"), (7, "C"), (7, "D"), (8, "C"), (9, "D")]
    pages = spark.createDataFrame([(i, "u", h, "p") for i, h in rows], PAGES).repartition(3)
    top = {"A": 6, "B": 9, "C": 8, "D": 9}
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()]
    want = [(i, warc.digest_of(h.encode()), "response" if i == top[h] else "revisit", None if i == top[h] else top[h]) for i, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_directory_of_a_zip64_archive_with_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"abc")
        z.writestr("é", b"defg")
        z.writestr(zipfile.ZipInfo("packed"), b"h" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is no end record here"
    raw = out.getvalue()
    members = warc.directory(io.BytesIO(raw), len(raw))
    assert list(members) == ["big", "é", "packed"]
    for name, body in (("big", b"abc"), ("é", b"defg")):
        at = warc.data_at(io.BytesIO(raw), members[name])
        assert raw[at:at + members[name].size] == body
    with pytest.raises(ValueError):
        warc.data_at(io.BytesIO(raw), members["packed"])
    # The same directory behind a ZIP64 end record: marker values lead to the locator.
    end = raw.rfind(b"PK\x05\x06", 0, len(raw) - len(b"PK\x05\x06 is no end record here"))
    count, length, offset = struct.unpack_from("<HII", raw, end + 10)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, offset)
    wide = raw[:end] + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert list(warc.directory(io.BytesIO(wide), len(wide))) == ["big", "é", "packed"]
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no archive" * 10), 100)


def test_nearest_recall_ties_and_odd_vectors(spark):
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(600, 6))
    x[50:90] = x[0]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 6, 1), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] + [0.0] * 5, 1), (1005, [1.0], 1), (None, [1.0] * 6, 1), (1100, [], 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    asked = vectors.filter("vec_id % 100 = 0")
    full = nearest.nearest(vectors, asked, candidates=10_000).collect()
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in full if r.query_id == q)
        assert [v for _, v, _ in got] == want.tolist() and [r for r, _, _ in got] == list(range(1, 11))
        assert [s for _, _, s in got] == [d[v] for v in want]
    assert len(full) == 60
    some = nearest.nearest(vectors, asked, candidates=150, share=0, centres=8).collect()
    assert len({(r.query_id, r.vec_id) for r in some} & {(r.query_id, r.vec_id) for r in full}) >= 40
    few = vectors.filter("vec_id < 4")
    assert nearest.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert nearest.nearest(vectors.limit(0), asked).count() == 0 and nearest.nearest(vectors, asked.limit(0)).count() == 0


def test_walk_takes_cells_in_order_of_summed_distance():
    random_ = np.random.default_rng(2)
    a, b, counts = random_.random(7), random_.random(5), random_.integers(0, 4, 35)
    cells = nearest.traverse(a, b, counts, 10**9)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(counts).tolist())
    part = nearest.traverse(a, b, counts, 12)
    assert cells[:len(part)] == part and counts[part].sum() >= 12 > counts[part[:-1]].sum()


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    asked = [i for i in ids if i % 100 == 0]
    got = nearest.nearest(vectors, vectors.filter("vec_id % 100 = 0"), candidates=1_000).collect()
    right = 0
    for q in asked:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        right += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert right / (10 * len(asked)) >= 0.9


def test_pipeline_against_its_stages_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near duplicates", "decontamination", "encoding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        assert after.keys() <= before.keys()
        if name == "lines":
            assert sorted((d, t) for d, t in after.items()) == sorted((d, t) for d, _, _, t in lines_by_hand(list(before.items())))
        else:
            assert all(before[d] == t for d, t in after.items())
        if name == "near duplicates":
            assert after.keys() == set(classes_by_hand(list(before.items())).values())
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert {r.doc_id: r.decoded_sha256 for r in last.collect()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect()}


def test_stages_stand_nulls_empty_tables_and_other_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(None, None, "a", 1, 0.5), (1, "", None, None, None), (1, "", "b", 2, 1.0), (2, "word " * 5_000, "c", 3, None)], "doc_id long, text string, source string, n_hit long, score double")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, folder)
            rows = out.collect()
            assert len(rows) <= given.count()
            assert name == "encoding" or out.columns == docs.columns
