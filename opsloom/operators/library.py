"""Reports over a nested game library: flat inventory, stores, ratings, modes, filters, activity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.columns import none_if_blank
from opsloom.session import cut_lineage

LISTS = ["genres", "features", "tags", "developers", "publishers", "platforms"]
STORE_NAMES = r"(?i)store|steam|gog|epic|xbox|ubisoft|origin|\bea\b|battle|amazon|itch"


def inventory(games: DataFrame) -> DataFrame:
    """One flat row per game: lists joined by "; ", hours with two decimals, ISO dates, no store as "None"."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return games.select(
        "id", "name", F.coalesce(none_if_blank(F.col("store")), F.lit("None")).alias("store"),
        (F.bround(F.col("playtime_sec") / 36) / 100).alias("hours"), day("last_played").alias("last_played"), day("added").alias("added"),
        day("released").alias("released"), "installed", "hidden", "favorite",
        *[F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ").alias(c) for c in LISTS])


def store_summary(games: DataFrame) -> DataFrame:
    return games.groupBy(F.coalesce(none_if_blank(F.col("store")), F.lit("None")).alias("store")).agg(F.count("*").alias("games")).orderBy(F.desc("games"), "store")


def score() -> Column:
    return F.coalesce("user_score", "community_score", "critic_score")


def stars(value: Column) -> Column:
    """0 to 5 stars for a score of 100, halves up; -1 without a score."""
    return F.when(value.isNull(), -1).otherwise(F.greatest(F.lit(0), F.least(F.lit(5), F.floor(value / 20 + 0.5).cast("int"))))


def rating(games: DataFrame) -> DataFrame:
    return games.withColumn("rating", score()).withColumn("stars", stars(F.col("rating")))


MODES = {"single": "single", "multi": "multiplayer|multi-player", "coop": "co-?op", "pvp": "pvp|versus"}


def mode_flags(games: DataFrame) -> DataFrame:
    has = lambda p: F.exists(F.coalesce("features", F.array().cast("array<string>")), lambda x: x.rlike("(?i)" + p))
    return games.withColumns({name: has(p) for name, p in MODES.items()})


def store_url(games: DataFrame) -> DataFrame:
    """First link named like a store, else the Steam page of a numeric id, else empty."""
    usable = F.filter(F.coalesce("links", F.array().cast("array<struct<name:string,url:string>>")),
                      lambda x: (F.coalesce(x["url"], F.lit("")) != "") & x["name"].rlike(STORE_NAMES))
    steam = F.when((F.col("store") == "Steam") & F.col("game_id").rlike(r"^\d+$"), F.concat(F.lit("https://store.steampowered.com/app/"), "game_id", F.lit("/")))
    return games.withColumn("store_url", F.coalesce(F.try_element_at(usable, F.lit(1))["url"], steam, F.lit("")))


def filter_library(games: DataFrame, name: str | None = None, store: str | None = None, installed: bool = False, played: bool = False,
                   mode: str | None = None, min_stars: int | None = None) -> DataFrame:
    out = games
    if name:
        out = out.filter(F.contains(F.lower("name"), F.lit(name.strip().lower())))
    if store:
        out = out.filter(F.coalesce(none_if_blank(F.col("store")), F.lit("None")) == store)
    if installed:
        out = out.filter("installed")
    if played:
        out = out.filter("playtime_sec > 0")
    if mode:
        out = mode_flags(out).filter(F.col(mode)).drop(*MODES)
    if min_stars is not None:
        out = out.filter(stars(score()) >= min_stars)
    return out


def sort_library(games: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Sort by name, playtime, recent, score or year; what lacks the value comes last either way."""
    column = {"name": F.lower("name"), "playtime": F.coalesce("playtime_sec", F.lit(0)), "recent": F.col("last_played"), "score": score(), "year": F.year("released")}[key]
    return games.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), "id")


def sorted_positions(games: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Every game's id and its ``position`` from 1 in the order of ``sort_library``.

    Partitions are sorted by range and counted; only their counts, one row each, meet in one place.
    """
    at = F.monotonically_increasing_id()
    # the upper bits are the partition's number, the lower 33 the row's place in it
    rows = cut_lineage(sort_library(games, key, descending).select("id", F.shiftright(at, 33).alias("__part"), at.bitwiseAND((1 << 33) - 1).alias("__row")))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return rows.join(sizes, "__part").select("id", (F.col("__start") + F.col("__row") + 1).alias("position"))


def activity(games: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """(counts with and without playtime, the most played games)."""
    played = F.coalesce("playtime_sec", F.lit(0)) > 0
    counts = games.agg(F.count_if(played).alias("played"), F.count_if(~played).alias("unplayed"), F.coalesce(F.sum("playtime_sec"), F.lit(0)).alias("seconds"))
    return counts, games.filter(played).orderBy(F.desc("playtime_sec"), "id").limit(top)


def relative_age(date: Column, today: Column) -> Column:
    days = F.datediff(today, date)
    months, years = F.floor(days / 30.44), F.floor(days / 365.25)
    said = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    return (F.when(date.isNull(), "").when(days < 1, "today").when(days < 2, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
            .when(months < 12, said(months, "month")).otherwise(said(years, "year")))


def gallery_totals(games: DataFrame, include_hidden: bool = False) -> DataFrame:
    rows = store_url(games if include_hidden else games.filter(~F.coalesce("hidden", F.lit(False))))
    return rows.agg(F.count("*").alias("total"), F.count_if("installed").alias("installed"), F.count_if(F.col("store_url") != "").alias("linked"),
                    F.countDistinct(F.coalesce(none_if_blank(F.col("store")), F.lit("None"))).alias("stores"))
