"""Operators that judge one text at a time, against plain versions, and their odd inputs."""
import base64
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers as vocabularies
import pytest
from pyspark.sql import functions as F

from opsloom.llm import bpe, decontaminate, personal_data, quality, token_counts, url_filter

DOCS = "doc_id long, text string, lang string"
LETTERS = "ab cdé中\U0001f600\x1c\x1d\x85\xa0　\u200b's1²½٣\n\t  \rªµĀɏɐ́!?.\x00"


def odd_texts():
    random.seed(1)
    made = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 80))) for _ in range(150)]
    return [None, "", " ", "\n", "a" * 20_000, "the" * 9_000, "word " * 3_000, "x<|endoftext|>y <|endoftext|>", *made]


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], schema)


def test_ids_equal_the_library_and_decode(spark):
    import tiktoken

    path, texts = vocabularies.path("byte_bpe_multi_50k.tiktoken"), odd_texts()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = bpe.encode(table(spark, texts), path, vocabularies.PATTERN)
    rows = bpe.decode(made, path, vocabularies.PATTERN).collect()
    assert made.columns == ["doc_id", "text", "lang", "n_tokens", "ids"]
    for r in rows:
        text = texts[r.doc_id] or ""
        want = own.encode_ordinary(text)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(table(spark, []), path, vocabularies.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(table(spark, []).withColumnRenamed("lang", "IDS"), path, vocabularies.PATTERN)


def test_small_memory_of_pretokens_changes_nothing():
    texts = [t for t in odd_texts() if t]
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    small, large = bpe.Codec(path, vocabularies.PATTERN, keep=5), bpe.Codec(path, vocabularies.PATTERN)
    assert [small.encode_all([t])[0] for t in texts] == large.encode_all(texts)
    assert all(large.merged_long(t.encode()) == large.merged_many([t.encode()])[0] for t in ("abababab", "aaaaaaaaaaaaa", "éééé", "the thethe"))


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path, texts = vocabularies.path("byte_bpe_50k.json"), odd_texts()
    own = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(table(spark, texts), path, vocabularies.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(table(spark, []), path, vocabularies.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(table(spark, []).withColumnRenamed("lang", "n_bytes"), path, vocabularies.PATTERN)


WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_contamination(text, items, size=10):
    found = WORD.findall((text or "").translate(SMALL))
    hit, names = set(), set()
    for name, body in items:
        w = WORD.findall((body or "").translate(SMALL))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(found) - n + 1):
                if found[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    names |= {str(name)} - {"None"}
    return len(found), len(hit), sorted(names)


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_contamination_equals_windows_by_hand(spark, block):
    random.seed(2)
    w = [f"w{i}" for i in range(12)] + ["é", "ß1"]
    item = [" ".join(random.choices(w, k=n)) for n in (14, 25, 3, 1, 10)]
    items = [(1, item[0]), (2, item[1]), (3, item[2]), (10, item[3].upper()), (4, item[4]), (5, None), (6, "?!"), (None, "only here " + item[0]), (1, item[0]), (7, item[0])]
    texts = [None, "", "...", item[0], f"x, {item[0].upper()} - y", f"a {item[1]}. b {item[1]}! {item[4]}", item[2], f"é{item[2]}", " ".join(random.choices(w, k=400)), item[0][:-1] + "zz", "w3 " * 30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    for r in decontaminate.contamination(docs, bench, block_bytes=block).collect():
        n, hit, names = plain_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names), r
        inside = [WORD.findall(texts[r.doc_id][s.start:s.end].translate(SMALL)) for s in r.spans]
        assert sum(map(len, inside)) == hit
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(docs.withColumnRenamed("lang", "N_HIT"), bench)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_fixed_patterns_equal_the_plain_ones():
    random.seed(3)
    pool = ["@", ".", "a", "b1", "-", "+", " ", "1", "22", "255", "256", "4111 1111 1111 1111", "x@y.com", "1.2.3.4", "+1 (234) 555-7890", "(", ")", "\n", "é"]
    for _ in range(4000):
        text = "".join(random.choices(pool, k=random.randint(0, 14)))
        assert personal_data.base_spans(text) == plain_base(text), text
    for text in ("1" * 60_000, "a" * 60_000 + "@", "a@" * 20_000, "1." * 30_000, "+1 " * 20_000, "1" + " " * 60_000):
        personal_data.base_spans(text)


def test_field_adds_other_writings_and_keeps_the_base(spark):
    random.seed(4)

    def card():
        d = [random.randint(0, 9) for _ in range(15)]
        return next("".join(map(str, d)) + str(c) for c in range(10) if personal_data.luhn("".join(map(str, d)) + str(c)))

    def ip():
        return ".".join(str(random.randint(0, 255)) for _ in range(4))

    texts = [None, "", "no digits here"] + [random.choice([
        f"write to name{i}.x@mail{i % 7}.example.com today", f"pay with {card()} now", f"from {ip()} at night", f"call +1 ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)} or not",
        f"in {random.randint(1900, 2030)} there were {random.randint(1, 10**7)} of {random.randint(1, 10**10)}"]) for i in range(600)]
    docs = table(spark, texts)
    field = personal_data.train(docs)
    number = card()
    tests = {"the address 12[.]34[.]56[.]78 was seen": "ip", f"number {number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]} then": "card", "built 1998, sold 20031 of them": None, "": None}
    for text, kind in tests.items():
        assert {k for k, *_ in personal_data.all_spans(text, field)} == ({kind} if kind else set()), text
    rows = personal_data.find(docs, field).collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_base(texts[r.doc_id] or "")
    assert sum(not s.base for r in rows for s in r.spans) <= len(rows) // 50
    assert personal_data.find(docs.limit(0), field).count() == 0
    assert personal_data.train(docs.limit(0)).weights == {}
    with pytest.raises(ValueError):
        personal_data.find(docs.withColumnRenamed("lang", "spans"), field)


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_labels(docs, labels)
    held = quality.score(docs, model).join(labels, "doc_id").filter(quality.remainder(F.col("doc_id")) == 1)
    right, n = held.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93
    odd = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, "a" * 300_000, None), (3, "\n\n", None)], DOCS)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score == rows[2].score
    assert quality.score(odd.limit(0), model).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit_labels(docs, labels.limit(0))).collect()} == {0.5}
    with pytest.raises(ValueError):
        quality.score(odd.withColumnRenamed("lang", "Score"), model)


def test_pooling_rises():
    assert quality.pooled(np.array([1.0, 0.0, 3.0, 2.0, 5.0]), np.array([1, 1, 1, 3, 1])).tolist() == [0.5, 0.5, 2.25, 2.25, 5.0]


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), (None, "/", "block"), ("com", None, "block")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/12?q=/es/", "https://notexample.org/es/", "x://example.org?/es/", "x://org", "x://org/", "y://deep.org/z#/",
            "a://b://example.org/es/", "http://example.org/es", "h://com/", "x://" + "a." * 3000 + "org/" + "p" * 3000]

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, "deny"
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path, host = re.split("[?#]", rest[len(host):], maxsplit=1)[0], host.translate(SMALL)
        fits = [(len(h + p), h + p, v) for h, p, v in sorted(rules[:4], key=str) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: f[0], default=(0, None, "deny"))
        return host, path, best[1], best[2]

    pages = spark.createDataFrame([(i % 12, u, "x") for i, u in enumerate(urls)], "page_id long, url string, d string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (url_filter.SMALL_RULES, 0):
        url_filter.SMALL_RULES, before = limit, url_filter.SMALL_RULES
        rows = url_filter.judge_urls(pages, given, default="deny").collect()
        url_filter.SMALL_RULES = before
        assert sorted((r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in rows) == sorted((u or "", h, p, r or "", v) for u in urls for h, p, r, v in [plain(u)])
    assert url_filter.judge_urls(pages.limit(0), given).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, given.limit(0)).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages.withColumnRenamed("d", "Host"), given)


def test_digest_is_of_the_whole_text(spark):
    text = "á b" * 5_000
    row = bpe.encode(table(spark, [text]), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN, decoded="d").select(F.sha2("d", 256).alias("h")).first()
    assert row.h == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_of_personal_data_are_read_in_proportion():
    field = personal_data.Field({"1": np.ones(len(personal_data.KINDS))})
    for part in ("1.2.3.4 ", "+1 234 567 8901 ", "ab.cd@ef.gh "):
        began = time.monotonic()
        spans = personal_data.all_spans(part * (400_000 // len(part)), field)
        assert len(spans) >= 400_000 // len(part) and time.monotonic() - began < 20


def test_own_names_clash_with_nothing(spark):
    rows = spark.createDataFrame([(1, b"\x00\x00\x00\x00", "x")], "doc_id long, ids binary, decoded string")
    with pytest.raises(ValueError):
        bpe.decode(rows, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, __text string")
    assert quality.described(docs, "text", F.col("__text")).first()["__text"] == "x"
