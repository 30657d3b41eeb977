"""Category tree: paths, effective group, visibility, merge, duplicate repair, source labels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.rules import (
    BUILTIN_CATEGORIES, INCOME_HINT, SOURCE_GROUPS, TRANSFER_HINT, first_match, kind_of,
)
from opsloom.session import cut_lineage

SEPARATOR = " › "
PATH_DEPTH = 5
TOP_DEPTH = 6


def _climb(cats: DataFrame, levels: int, carry: dict[str, Column]) -> DataFrame:
    """Join each node with its ancestors, one equi-join per level; columns end in ``_<level>``."""
    up = cats.select(F.col("id").alias("__pid"), F.col("parent_id").alias("__pp"),
                     *[c.alias(f"__{n}") for n, c in carry.items()])
    out = cats.withColumn("parent_0", F.col("parent_id"))
    for i in range(1, levels + 1):
        step = up.select(F.col("__pid").alias(f"anc_{i}"), F.col("__pp").alias(f"parent_{i}"),
                         *[F.col(f"__{n}").alias(f"{n}_{i}") for n in carry])
        out = out.join(step, F.col(f"parent_{i - 1}") == F.col(f"anc_{i}"), "left")
    return out


def _chains(cats: DataFrame) -> DataFrame:
    """``id, chain``: each node and all its ancestors, nearest first, to the root or round a cycle once.

    Every round doubles what a chain holds, so a tree of depth n takes log n rounds.
    """
    known = cats.select(F.col("id").alias("__aid"))
    state = cut_lineage(cats.select("id", F.array("id").alias("chain"), F.col("parent_id").alias("up")).join(
        known, F.col("up") == F.col("__aid"), "left").select("id", "chain", F.col("__aid").alias("up")))
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        step = state.select(F.col("id").alias("__aid"), F.col("chain").alias("__more"), F.col("up").alias("__up"))
        longer = state.join(step, F.col("up") == F.col("__aid"), "left").select(
            "id", F.array_distinct(F.concat("chain", F.coalesce("__more", F.array().cast(state.schema["chain"].dataType)))).alias("chain"), F.col("__up").alias("up"))
        state = cut_lineage(longer.withColumn("up", F.when(~F.array_contains("chain", F.col("up")), F.col("up"))))
    return state.select("id", "chain")


def category_paths(cats: DataFrame) -> DataFrame:
    """Add ``path`` (names joined from the root, at most five parents) and ``top_id`` (at most six up)."""
    out = _climb(cats, TOP_DEPTH, {"name": F.col("name")})
    names = [F.col(f"name_{i}") for i in range(PATH_DEPTH, 0, -1)] + [F.col("name")]
    top = F.coalesce(*[F.col(f"anc_{i}") for i in range(TOP_DEPTH, 0, -1)], F.col("id"))
    return out.withColumn("path", F.concat_ws(SEPARATOR, *names)).withColumn("top_id", top).select(
        *cats.columns, "path", "top_id")


def category_groups(cats: DataFrame) -> DataFrame:
    """Add ``effective_group``: a built-in's own name, else the nearest ``system_group`` upward, however high; "-" stops.

    ``cats`` has id, name, parent_id, user_id (null for built-ins) and system_group.
    """
    own = F.when(F.col("user_id").isNull(), F.col("name")).otherwise(
        F.when(F.col("system_group") != "", F.col("system_group")))
    above = _chains(cats).select("id", F.posexplode("chain").alias("__n", "__aid"))
    owns = cats.select(F.col("id").alias("__aid"), own.alias("__own")).filter(F.col("__own").isNotNull())
    nearest = above.join(owns, "__aid").groupBy("id").agg(F.min_by("__own", "__n").alias("__group"))
    return cats.join(nearest, "id", "left").withColumn("effective_group", F.when(F.col("__group") != "-", F.col("__group"))).select(
        *cats.columns, "effective_group")


def visible_categories(cats: DataFrame, hidden: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: built-ins and own categories, minus hidden ones and built-ins shadowed by an own top-level name."""
    own = cats.filter(F.col("user_id").isNotNull()).withColumn("viewer", F.col("user_id"))
    # built-ins are a fixed short list, so each user takes them as one array value
    builtin = cats.filter(F.col("user_id").isNull()).agg(F.collect_list(F.struct(*cats.columns)).alias("b"))
    shared = users.select(F.col("user_id").alias("viewer"), F.explode(builtin.scalar()).alias("c")).select(
        *[F.col(f"c.{c}").alias(c) for c in cats.columns], "viewer")
    shadow = own.filter(F.col("parent_id").isNull()).select("viewer", F.lower("name").alias("__low")).distinct()
    shared = shared.withColumn("__low", F.lower("name")).join(shadow, ["viewer", "__low"], "left_anti").drop("__low")
    gone = hidden.select(F.col("user_id").alias("viewer"), F.col("category_id").alias("id"))
    return own.unionByName(shared).join(gone, ["viewer", "id"], "left_anti")


def merge_categories(txns: DataFrame, rules: DataFrame, budgets: DataFrame, cats: DataFrame,
                     moves: DataFrame) -> dict[str, DataFrame]:
    """Repoint everything of ``src_id`` to ``dst_id``. ``moves(user_id, src_id, dst_id)`` holds one row per merge.

    A moved budget is dropped where the target already has one; own sources disappear, built-in sources are
    returned as ``hidden`` rows.
    """
    moves = moves.filter(F.col("src_id") != F.col("dst_id"))

    def repoint(df: DataFrame, column: str) -> DataFrame:
        m = moves.select(F.col("user_id"), F.col("src_id").alias(column), F.col("dst_id").alias("__to"))
        return (df.join(m, ["user_id", column], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
                .select(*df.columns))

    moved_txns = repoint(txns, "category_id")
    kinds = cats.select(F.col("id").alias("category_id"), F.col("kind").alias("__kind"))
    touched = moves.select("user_id", F.col("dst_id").alias("category_id")).distinct().withColumn("__hit", F.lit(True))
    moved_txns = (
        moved_txns.join(kinds, "category_id", "left").join(touched, ["user_id", "category_id"], "left")
        .withColumn("direction", F.when(F.col("__hit"), direction(F.col("__kind"), F.col("amount_cents")))
                    .otherwise(F.col("direction"))).select(*txns.columns))
    marked = budgets.join(
        moves.select("user_id", F.col("src_id").alias("category_id"), F.col("dst_id").alias("__to")),
        ["user_id", "category_id"], "left")
    target = F.coalesce("__to", "category_id")
    keep = Window.partitionBy("user_id", "__target").orderBy(F.col("__to").isNotNull(), "id")
    new_budgets = (marked.withColumn("__target", target).withColumn("__n", F.row_number().over(keep))
                   .filter(F.col("__to").isNull() | (F.col("__n") == 1))
                   .withColumn("category_id", F.col("__target")).select(*budgets.columns))
    own = moves.select("user_id", F.col("src_id").alias("id"))
    child = moves.select("user_id", F.col("src_id").alias("parent_id"), F.col("dst_id").alias("__to"))
    left = (cats.join(own, ["user_id", "id"], "left_anti").join(child, ["user_id", "parent_id"], "left")
            .withColumn("parent_id", F.coalesce("__to", "parent_id")).select(*cats.columns))
    builtin = cats.filter(F.col("user_id").isNull()).select(F.col("id").alias("src_id"))
    hidden = moves.join(builtin, "src_id", "left_semi").select("user_id", F.col("src_id").alias("category_id"))
    return {"transactions": moved_txns, "rules": repoint(rules, "category_id"), "budgets": new_budgets,
            "categories": left, "hidden": hidden}


def refused_moves(cats: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves ``(id, new_parent_id)`` that would put a node under itself, or beside a sibling of the same name."""
    chain = _chains(cats).select(F.col("id").alias("new_parent_id"), F.col("chain").alias("__chain"))
    named = moves.join(cats.select("id", F.lower(F.trim("name")).alias("__low")), "id")
    sibling = cats.select(F.col("parent_id").alias("new_parent_id"), F.lower(F.trim("name")).alias("__low"),
                          F.col("id").alias("__sid"))
    return (
        named.join(chain, "new_parent_id", "left").join(
            sibling, ["new_parent_id", "__low"], "left")
        .withColumn("reason", F.when(F.array_contains("__chain", F.col("id")), "under its own descendant")
                    .when(F.col("__sid").isNotNull() & (F.col("__sid") != F.col("id")), "name already used there"))
        .filter(F.col("reason").isNotNull()).select("id", "new_parent_id", "reason").distinct())


def dedupe_categories(cats: DataFrame, txns: DataFrame) -> DataFrame:
    """Map of ``(user_id, src_id, dst_id)`` that merges same-named siblings, repeated while children move together.

    Kept: most used, then not all lower case, then imported, then the greater name, then the greater id. A
    round merges one more level at least, and the loop ends with the first that finds nothing to merge.
    """
    used = txns.groupBy("user_id", "category_id").agg(F.count("*").alias("__used"))
    state = cats.filter(F.col("user_id").isNotNull()).join(
        used.select("user_id", F.col("category_id").alias("id"), "__used"), ["user_id", "id"], "left").select(
        "user_id", "id", "name", "parent_id", "origin", F.coalesce("__used", F.lit(0)).alias("used"),
        F.col("id").alias("final"))
    while True:
        best = Window.partitionBy("user_id", "__low", "parent_id").orderBy(
            F.desc("used"), F.desc(F.col("name") != F.lower("name")), F.desc(F.coalesce(F.col("origin") == "import", F.lit(False))),
            F.desc("name"), F.desc("id"))
        live = state.filter(F.col("id") == F.col("final"))
        pick = (live.withColumn("__low", F.lower(F.trim("name")))
                .withColumn("__keep", F.first("id").over(best)).filter(F.col("__keep") != F.col("id"))
                .select("user_id", F.col("id").alias("__src"), F.col("__keep").alias("__dst")))
        step = cut_lineage(pick)
        if step.isEmpty():
            break
        to_final = step.select("user_id", F.col("__src").alias("final"), F.col("__dst").alias("__f"))
        to_parent = step.select("user_id", F.col("__src").alias("parent_id"), F.col("__dst").alias("__p"))
        state = (state.join(to_final, ["user_id", "final"], "left").join(to_parent, ["user_id", "parent_id"], "left")
                 .select("user_id", "id", "name", F.coalesce("__p", "parent_id").alias("parent_id"), "origin", "used",
                         F.coalesce("__f", "final").alias("final")))
        total = state.groupBy("user_id", "final").agg(F.sum("used").alias("__sum"))
        state = cut_lineage(state.join(total, ["user_id", "final"]).withColumn(
            "used", F.when(F.col("id") == F.col("final"), F.col("__sum")).otherwise(F.lit(0))).drop("__sum")
            .select("user_id", "id", "name", "parent_id", "origin", "used", "final"))
    return state.filter(F.col("id") != F.col("final")).select("user_id", F.col("id").alias("src_id"), F.col("final").alias("dst_id"))


def direction(kind: Column, amount_cents: Column) -> Column:
    return (F.when(kind.isNull(), F.when(amount_cents > 0, "income").otherwise("expense"))
            .when(kind == "transfer", "transfer")
            .when(kind == "income", F.when(amount_cents >= 0, "income").otherwise("expense"))
            .otherwise("expense"))


def group_for(label: Column) -> Column:
    return first_match(label, SOURCE_GROUPS, ignore_case=True)


def build_category_tree(labels: DataFrame) -> DataFrame:
    """Distinct nodes of ``Parent:Child`` labels (at most four levels) with kind, group and essential flag.

    ``labels`` has a ``label`` column (and keeps ``user_id`` if present); ids are the hash of the lower-cased path.
    """
    by = [c for c in ("user_id",) if c in labels.columns]
    parts = F.slice(F.filter(F.transform(F.split("label", ":"), lambda p: F.substring(F.trim(p), 1, 60)),
                             lambda p: p != ""), 1, 4)
    rows = labels.select(*by, "label").distinct().withColumn("__parts", parts).withColumn(
        "__parts", F.when(F.size("__parts") == 0, F.array(F.lit("Uncategorized"))).otherwise(F.col("__parts")))
    nodes = rows.select(*by, "__parts", F.explode(F.sequence(F.lit(1), F.size("__parts"))).alias("depth"))
    prefix = F.concat_ws(":", F.slice("__parts", 1, F.col("depth")))
    nodes = nodes.select(
        *by, "depth", F.element_at("__parts", F.col("depth")).alias("name"), prefix.alias("full"),
        F.when(F.col("depth") > 1, F.concat_ws(":", F.slice("__parts", 1, F.col("depth") - 1))).alias("__up"),
        (F.col("depth") == F.size("__parts")).alias("leaf"))
    grouped = nodes.withColumn("group", F.when(F.col("leaf"), group_for(F.col("full"))).otherwise(group_for(F.col("name"))))
    essential = F.col("group").isin(*[n for n, _, e in BUILTIN_CATEGORIES if e])
    implied = kind_of(F.col("group"))
    kind = (F.when(F.col("full").rlike("(?i)" + TRANSFER_HINT) | (implied == "transfer"), "transfer")
            .when(F.col("full").rlike("(?i)" + INCOME_HINT) | (implied == "income"), "income").otherwise("expense"))
    typed = grouped.withColumn("kind", kind).withColumn("essential", F.coalesce(essential, F.lit(False)))
    ident = F.lower(F.col("full"))
    return (
        typed.withColumn("id", F.sha2(ident, 256)).withColumn("parent_id", F.sha2(F.lower("__up"), 256))
        .groupBy(*by, "id").agg(
            F.min_by(F.struct("name", "full", "group", "kind", "essential", "parent_id", "depth"),
                     F.struct(~F.col("leaf"), F.col("full"))).alias("n"))
        .select(*by, "id", "n.*").withColumnRenamed("full", "path"))
