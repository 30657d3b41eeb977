"""The Merkle manifest and the conversation repair against brute force."""
import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from opsloom.llm import conversations, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
TURNS = "conv_id long, turn long, role string, text string, extra string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    leaves = {}
    for r in rows:
        leaves.setdefault(r[2], []).append((r[0], digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, i):
        for nodes in levels[:-1]:
            first = i // 8 * 8
            yield from nodes[first:i] + nodes[i + 1:first + 8]
            i //= 8

    groups = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        leaves[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([leaf for _, leaf in leaves[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups]) if groups else [[None]]
    return [(d, leaf, trees[g][-1][0], top[-1][0], digest(*siblings(trees[g], i), *siblings(top, n)))
            for n, g in enumerate(groups) for i, (d, leaf) in enumerate(leaves[g])]


def some_documents():
    random.seed(3)
    rows = [(random.choice([i, 3 * i, random.randint(-2 ** 62, 2 ** 62), i + 40_000]), random.choice([None, "a", "b"]), random.choice([None, "en", "e", "é", "zh"]) if i % 3 else "en",
             random.choice([None, 3]), random.choice([None, "", "Ab é", "x" * 5000])) for i in range(500)]
    return rows + [(5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "y"), (None, "a", "en", 1, "y"), (None, "a", "en", 1, "z"), (None, None, "q", 1, "z"), (7, None, "one", 1, "z")]


@pytest.mark.parametrize("rows", [some_documents(), [(1, None, None, None, None)], [], [(i, None, f"l{i % 11}", 1, "t") for i in range(90)]])
def test_manifest_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", pos string").withColumn("leaf", F.lit(1))
    made = merkle.manifest(docs, claims={"text": F.translate("text", "A", "a")})
    got = made.withColumn("proof", merkle.proof_digest(F.col("steps"))).withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).withColumn(
        "claim", merkle.folded(F.col("claimed"), F.col("steps"))).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=repr) == sorted(manifest_by_hand(rows), key=repr)
    assert all(r.folded == r.root for r in got)
    assert all((r.claim == r.root) == (r.claimed == r.leaf) for r in got)


def hurt(rows):
    """Rows per conversation after the damage, in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def repaired_by_hand(rows):
    """Best-first search over (row, role initials so far as a state) with whole edit strings."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    out = []
    for conv, kept in hurt(rows).items():
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, made = heapq.heappop(queue)
            if i == len(kept) and last in ("", "a"):
                break
            if (i, last, audit, cost) in done or len(audit) > 2 * len(kept) + 4:
                continue
            done.add((i, last, audit, cost))
            for r in after[last].replace("s", ""):
                heapq.heappush(queue, (cost + 3, audit + "I", i, r, (*made, ("user:" if r == "u" else "assistant:"))))
            if i < len(kept):
                _, role, text = kept[i]
                heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, made))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    if role[:1] and role[:1] in after[last]:
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                    for r in after[last].replace("s", ""):
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, r, (*made, f"{'user' if r == 'u' else 'assistant'}:{text}")))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def some_conversations():
    random.seed(4)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(random.randint(1, 7)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 3, None]), random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         random.choice(["Good.", "so", "so\n ", "Why? ", None, "", " \t", "é!", "Same."]), "x"))
    return rows + [(99, 1, "user", "Again.", None)] * 3


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_repair_equals_brute_force(spark, chunk):
    rows = some_conversations()
    table = spark.createDataFrame(rows, TURNS).withColumn("digest", F.lit("x")).repartition(3)
    got = conversations.repair(conversations.damaged(table), chunk=chunk).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(repaired_by_hand(rows), key=repr)


def test_repair_of_nothing_and_of_long_conversations(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], TURNS))).count() == 0
    # One conversation of many rows over many chunks: alternating roles need no edit but those for the damage.
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    one, whole = (conversations.repair(conversations.damaged(long), chunk=c).collect() for c in (1000, 1 << 16))
    assert one == whole and len(one[0].audit) > 15_000


def test_repair_plan_deals_rows_once_per_stream(spark, sf):
    made = conversations.repair(conversations.damaged(spark.read.parquet(f"{sf}/conversations.parquet")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(conv") == 1 and "Cartesian" not in plan
