"""Merkle manifest of a table: bitmaps of ids give leaf positions by rank, slot arrays reduce the levels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ids of one bitmap (32,768, as Spark's bitmap functions have it) and of one block of its popcount directory.
BITMAP_BITS, BLOCK_BITS = 15, 9
STEP = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value (numbers in decimals)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give: at each level the run with the node in its place is hashed."""
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _offsets(containers: DataFrame) -> DataFrame:
    """Rows of the group before each bitmap (``base``) and in the whole group (``total``).

    Counts go up a radix of 15 bits of the id at a time and offsets come down again, so that no window holds
    more than 32,768 rows (half a million at the top), however wide and sparse the ids lie.
    """
    levels = [containers.select("g", "bucket", "rows")]
    for _ in range(2):
        levels.append(levels[-1].groupBy("g", F.shiftright("bucket", BITMAP_BITS).alias("bucket")).agg(F.sum("rows").alias("rows")))
    top = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(top.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = levels[2].select("g", F.col("bucket").alias("up"), before.alias("base"), F.sum("rows").over(top).alias("total"))
    for level in (levels[1], levels[0]):
        inside = Window.partitionBy("g", "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        local = level.withColumn("up", F.shiftright("bucket", BITMAP_BITS)).withColumn("local", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        known = local.join(known, ["g", "up"]).select("g", "bucket", (F.col("base") + F.col("local")).alias("base"), "total")
        known = known.withColumnRenamed("bucket", "up")
    return known.withColumnRenamed("up", "bucket")


def _bitmaps(rows: DataFrame) -> DataFrame:
    """One compressed bitmap for each group and range of 32,768 ids: blocks without a bit are left out, the others
    have the popcount of all before them. Tasks build partial bitmaps; merging them is the aggregation."""
    low = F.col("id").bitwiseAND((1 << BITMAP_BITS) - 1)
    raw = (rows.filter("id IS NOT NULL").groupBy("g", F.shiftright("id", BITMAP_BITS).alias("bucket"))
           .agg(F.count("*").alias("rows"), F.bitmap_construct_agg(low).alias("bits")))
    size = 1 << (BLOCK_BITS - 3)
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.lit((1 << BITMAP_BITS - BLOCK_BITS) - 1)), lambda i: F.struct(
        i.alias("block"), F.bitmap_count(F.substring("bits", F.lit(1), i * size)).alias("before"), F.substring("bits", i * size + 1, F.lit(size)).alias("bits"))),
        lambda b: F.bitmap_count(b["bits"]) > 0)
    return raw.select("g", "bucket", "rows", F.bitmap_count("bits").alias("ids"), blocks.alias("blocks"))


def _rank(id: Column, blocks: Column) -> Column:
    """How many ids of the bitmap are smaller."""
    low = id.bitwiseAND((1 << BITMAP_BITS) - 1).cast("int")
    block = F.element_at(F.filter(blocks, lambda b: b["block"] == F.shiftright(low, BLOCK_BITS)), 1)
    inside = low.bitwiseAND((1 << BLOCK_BITS) - 1)
    whole = F.shiftright(inside, 3)
    last = F.ascii(F.decode(F.substring(block["bits"], whole + 1, F.lit(1)), "ISO-8859-1"))
    mask = F.pow(F.lit(2), inside.bitwiseAND(7)).cast("int") - 1
    return block["before"] + F.bitmap_count(F.substring(block["bits"], F.lit(1), whole)) + F.bit_count(last.bitwiseAND(mask))


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` (``g``, ``id``, ``leaf`` and others) with ``pos``, their place in the group by id, and ``total``.

    Null ids come first. Rows of one id are placed by leaf, equal ones in any order, which changes no digest;
    only such rows go through a window by id (and the first hex digits of the leaf where ids are null).
    """
    bitmaps = stored(_bitmaps(rows), "bitmaps")
    nulls = rows.filter("id IS NULL").groupBy("g").agg(F.count("*").alias("nulls"))
    offsets = _offsets(bitmaps)
    placed = bitmaps.join(offsets, ["g", "bucket"]).join(nulls, "g", "left").withColumn("nulls", F.coalesce("nulls", F.lit(0)))
    # Bitmaps with more rows than ids: how many further rows each repeated id brings.
    crowded = bitmaps.filter("rows > ids").select("g", "bucket")
    bucket = F.shiftright("id", BITMAP_BITS)
    again = (rows.filter("id IS NOT NULL").select("g", "id", bucket.alias("bucket")).join(crowded, ["g", "bucket"], "left_semi")
             .groupBy("g", "bucket", "id").agg((F.count("*") - 1).alias("more")).filter("more > 0")
             .groupBy("g", "bucket").agg(F.collect_list(F.struct("id", "more")).alias("extra")))
    placed = stored(placed.join(again, ["g", "bucket"], "left").select("g", "bucket", "blocks", "extra", (F.col("base") + F.col("nulls")).alias("base"),
                                                                       (F.col("total") + F.col("nulls")).alias("total")), "ranks")
    met = rows.filter("id IS NOT NULL").withColumn("bucket", bucket).join(placed, ["g", "bucket"])
    extra = F.aggregate(F.filter("extra", lambda e: e["id"] < F.col("id")), F.lit(0).cast("long"), lambda n, e: n + e["more"])
    met = met.withColumn("pos", (F.col("base") + _rank(F.col("id"), F.col("blocks")) + F.coalesce(extra, F.lit(0))).cast("long"))
    met = met.withColumn("twice", F.coalesce(F.exists("extra", lambda e: e["id"] == F.col("id")), F.lit(False))).drop("blocks", "extra", "base", "bucket")
    met = stored(met, "placed")
    turn = F.row_number().over(Window.partitionBy("g", "id").orderBy("leaf")) - 1
    out = met.filter("NOT twice").unionByName(met.filter("twice").withColumn("pos", F.col("pos") + turn)).drop("twice")
    # Rows without an id: counts by the leaf's first digits, then a window inside each of those.
    without = rows.filter("id IS NULL").withColumn("head", F.substring("leaf", 1, 3))
    heads = without.groupBy("g", "head").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = nulls.join(placed.groupBy("g").agg(F.max("total").alias("total")), "g", "left").select("g", F.coalesce("total", "nulls").alias("total"))
    heads = heads.withColumn("start", start).drop("n").join(totals, "g")
    inner = F.row_number().over(Window.partitionBy("g", "head").orderBy("leaf")) - 1
    first = without.join(heads, ["g", "head"]).withColumn("pos", (F.col("start") + inner).cast("long")).drop("head", "start")
    return out.unionByName(first)


def _levels(nodes: DataFrame, fanout: int, carry: Sequence[str] = ()) -> list[DataFrame]:
    """Runs of each level: ``g``, ``pos``, ``total``, ``digest`` of the run and ``members`` (slot, digest and, on the
    lowest level, the carried columns), at most ``fanout`` of them. Groups that are down to one node stop."""
    most, levels, size = nodes.agg(F.max("total")).first()[0] or 0, [], 1
    while size < most:
        slot = F.struct((F.col("pos") % fanout).alias("slot"), "digest", *([] if levels else carry))
        runs = (nodes.filter(F.col("total") > size).groupBy("g", F.floor(F.col("pos") / fanout).alias("run"))
                .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(slot)).alias("members")))
        runs = runs.select("g", F.col("run").alias("pos"), "total", F.sha2(F.array_join("members.digest", ""), 256).alias("digest"), "members")
        levels.append(stored(runs, "level"))
        nodes, size = levels[-1].select("g", "pos", "total", "digest"), size * fanout
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """What remains of each group: the node of a level that had no other."""
    tops = nodes.filter("total = 1").select("g", "digest")
    for i, runs in enumerate(levels):
        tops = tops.unionByName(runs.filter((F.col("total") > fanout ** i) & (F.col("total") <= fanout ** (i + 1))).select("g", "digest"))
    return tops


def _steps(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Members of the lowest runs with the siblings on their way up; ``tops`` has ``g``, ``subroot`` and the
    ``steps`` above it. Down the levels each run meets the node it became, by group and position."""
    below = tops.withColumn("pos", F.lit(0).cast("long"))
    above = None
    for i in range(len(levels) - 1, -1, -1):
        starts = below.join(levels[i].filter(F.col("total") <= fanout ** (i + 1)).select("g", "total"), "g").select("g", "pos", "subroot", "steps")
        parents = starts if above is None else above.unionByName(starts)
        met = levels[i].drop("digest", "total").join(parents, ["g", "pos"])
        met = met.select("g", F.col("pos").alias("run"), "subroot", "steps", "members", F.explode("members").alias("m"))

        def side(keep):
            return F.array_join(F.transform(F.filter("members", keep), lambda o: o["digest"]), "")

        step = F.struct(side(lambda o: o["slot"] < F.col("m.slot")).alias("before"), side(lambda o: o["slot"] > F.col("m.slot")).alias("after"))
        above = met.select("g", (F.col("run") * fanout + F.col("m.slot")).alias("pos"), "subroot", F.concat(F.array(step), "steps").alias("steps"), "m")
        if i:
            above = stored(above.drop("m"), "steps")
    return above


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             claims: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """One row for each given row: ``id``, ``group``, ``leaf``, ``claimed``, ``subroot``, ``root`` and ``steps``.

    A leaf is the SHA-256 of the encoded ``fields``; ``claimed`` is the same over the values that ``claims`` puts
    in their place, for verification (``folded(claimed, steps) == root``). In each group leaves ascend by id,
    null first; every ``fanout`` consecutive nodes (the last run may have fewer, even one) become their digest
    until one node remains, the subroot. Subroots, null group first, then bytewise, are reduced likewise to the
    root. ``steps`` lists, from the leaf up, the siblings to the left and right of the node in its run.

    Ids are whole numbers of up to 64 bits, dense or sparse. Null fields count as ``-``, empty texts as ``0:``.
    Repeated ids are leaves of their own, placed by digest, equal rows too. A group of one leaf has the leaf as
    its subroot; an empty table has no rows. Other columns of ``docs``, whatever their names, play no part.

    Texts are hashed where they lie; digests and ids move after that. Ids become one compressed bitmap per group
    and 32,768 ids, with popcounts, so that positions are rank queries and no group is sorted.
    """
    columns = [F.col(f"`{f}`") for f in fields]
    claimed = [(claims or {}).get(f, F.col(f"`{f}`")) for f in fields]
    grouped = F.col(f"`{group}`")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), grouped.alias("of"), F.coalesce(F.concat(F.lit("1"), grouped.cast("string")), F.lit("0")).alias("g"),
                       leaf_digest(columns).alias("leaf"), leaf_digest(claimed).alias("claimed"))
    rows = stored(rows, "leaves")
    nodes = stored(positions(rows).withColumn("digest", F.col("leaf")), "leaves")
    carry = ["id", "of", "claimed"]
    levels = _levels(nodes, fanout, carry)
    subroots = stored(_tops(nodes, levels, fanout), "subroots")
    # Groups in order: counts by the first letters, then a window inside each of those.
    ahead = subroots.withColumn("head", F.substring("g", 1, 4))
    heads = ahead.groupBy("head").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("head").orderBy("g")) - 1
    ranked = ahead.join(heads.withColumn("start", start), "head").select(
        F.lit("").alias("g"), (F.col("start") + inner).cast("long").alias("pos"), "digest", F.col("g").alias("part"))
    ranked = stored(ranked.withColumn("total", F.lit(subroots.count())), "subroots")
    upper = _levels(ranked, fanout, ["part"])
    found = _tops(ranked, upper, fanout).first()
    root = F.lit(found["digest"] if found else None).cast("string")
    none = F.array().cast(STEP)
    if upper:
        top = _steps(upper, _tops(ranked, upper, fanout).select("g", F.col("digest").alias("subroot"), none.alias("steps")), fanout)
        tops = top.select(F.col("m.part").alias("g"), F.col("m.digest").alias("subroot"), "steps")
    else:
        tops = ranked.select(F.col("part").alias("g"), F.col("digest").alias("subroot"), none.alias("steps"))
    tops = stored(tops, "tops")
    lone = nodes.filter("total = 1").join(tops, "g").select("id", "of", "leaf", "claimed", "subroot", "steps")
    out = lone
    if levels:
        out = _steps(levels, tops, fanout).select("m.id", "m.of", F.col("m.digest").alias("leaf"), "m.claimed", "subroot", "steps").unionByName(lone)
    return out.select(F.col("id").alias(id), F.col("of").alias(group), "leaf", "claimed", "subroot", root.alias("root"), "steps")
