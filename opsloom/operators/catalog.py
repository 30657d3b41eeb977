"""Catalogue entity resolution and tidying: linking, merging, grouping files, checks, layout plans.

Items and entries carry id / cat_id, path, title, author, product_id and optionally narrator.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions import titles as T
from opsloom.functions.columns import let, none_if_blank
from opsloom.operators.title_pairs import scored_pairs
from opsloom.session import cut_lineage

THRESHOLD = 82
TITLE_FLOOR = 90
NEAR_PATH = 97.0
# fixed values: descriptive fields, and the order in which sources are believed
FIELDS = ["title", "subtitle", "author", "narrator", "series", "series_index", "album", "albumartist", "genre", "year", "publisher",
          "description", "language", "asin", "isbn", "audible_url", "author_url", "original_release", "track", "disc", "comment"]
SOURCE_ORDER = ["audible", "openaudible", "existing", "openlibrary", "google", "musicbrainz", "folder"]
REQUIRED = [("title", "Missing Album/Title"), ("author", "Missing Author"), ("narrator", "Missing Narrator"), ("genre", "Missing Genre"),
            ("publisher", "Missing Publisher"), ("year", "Unknown Year"), ("description", "Missing Description")]
JUNK_FIELDS = ["title", "album", "author", "albumartist", "narrator", "series", "publisher", "genre", "comment", "subtitle"]


def drop_junk(df: DataFrame, columns: Sequence[str] = JUNK_FIELDS) -> DataFrame:
    return df.withColumns({c: T.without_junk(F.col(c)) for c in columns if c in df.columns})


# --- candidate pairs -----------------------------------------------------------------------------------------------

def near_keys(left: DataFrame, right: DataFrame, floor: float = NEAR_PATH) -> DataFrame:
    """Pairs of distinct keys whose sequence ratio is at least ``floor``: exact, and never all against all.

    Two such strings differ in at most ``k`` edits, ``k`` following from the right string's length; the right
    string is cut into ``k + 1`` pieces of which one survives unchanged: the i-th with at most i edits before it and
    k - i behind it, so its shift is at most i, and differs from that of the end by at most k - i. Pieces meet the
    substrings at those places in one equi-join on (length, piece number, text); only such pairs are measured.
    """
    slack = 1 - floor / 100
    distance = lambda n: F.floor(n * 2 * slack / (1 - slack) + 1e-9).cast("int")
    r = right.select(F.col("key").alias("rkey")).distinct().filter("rkey <> ''").withColumn("n", F.length("rkey")).withColumn("k", distance(F.col("n")))
    piece = F.floor(F.col("n") / (F.col("k") + 1)).cast("int")
    at = lambda i: i * piece + 1
    size = lambda i: F.when(i == F.col("k"), F.col("n") - i * piece).otherwise(piece)
    pieces = r.select("rkey", "n", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(
        i.alias("i"), F.substring("rkey", at(i), size(i)).alias("text")))).alias("p")).select("rkey", "n", "k", "p.*")
    lk = left.select(F.col("key").alias("lkey")).distinct().filter("lkey <> ''").withColumn("ln", F.length("lkey"))
    reach = distance(F.col("ln") * (1 + 2 * slack / (1 - slack))) + 1
    lengths = lk.select("lkey", "ln", F.explode(F.sequence(F.greatest(F.lit(1), F.col("ln") - reach), F.col("ln") + reach)).alias("n")).withColumn(
        "k", distance(F.col("n"))).filter(F.abs(F.col("n") - F.col("ln")) <= F.col("k"))
    probes = lengths.select("lkey", "n", "k", piece.alias("len"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), (F.col("ln") - F.col("n")).alias("more")).withColumns({
        "low": F.col("i") * F.col("len") + 1 - F.least(F.col("i"), F.col("k") - F.col("i") - F.col("more")),
        "high": F.col("i") * F.col("len") + 1 + F.least(F.col("i"), F.col("k") - F.col("i") + F.col("more"))}).filter("low <= high").select(
        "lkey", "n", "i", F.when(F.col("i") == F.col("k"), F.col("n") - F.col("i") * F.col("len")).otherwise(F.col("len")).alias("size"),
        F.explode(F.sequence(F.col("low"), F.col("high"))).alias("start")).filter("start >= 1").select(
        "lkey", "n", "i", F.substring("lkey", F.col("start"), F.col("size")).alias("text"))
    # Paths of one folder share pieces, so most pairs are far apart: a distance that gives up beyond k edits drops them before the ratio.
    pairs = probes.join(pieces, ["n", "i", "text"]).filter("levenshtein(lkey, rkey, k) >= 0").select("lkey", "rkey").distinct()
    return pairs.withColumn("ratio", T.sequence_ratio(F.col("lkey"), F.col("rkey"))).filter(F.col("ratio") >= floor)


# --- linking ---------------------------------------------------------------------------------------------------------

HINT = ["key", "a_key", "n_key"]


def hint_keys(items: DataFrame) -> DataFrame:
    """(id, key, a_key, n_key): normalised title without shelving words, author and narrator."""
    narrator = F.col("narrator") if "narrator" in items.columns else F.lit("")
    return items.select("id", T.norm_key(T.strip_title_suffix(F.coalesce("title", F.lit("")))).alias("key"),
                        T.norm_key(F.col("author")).alias("a_key"), T.norm_key(narrator).alias("n_key"))


def _entry_groups(catalog: DataFrame, keep: int) -> DataFrame:
    """Entries by (variant key, author, narrator) with their ``keep`` smallest ids; the rank limit works before the shuffle."""
    narrator = F.col("narrator") if "narrator" in catalog.columns else F.lit("")
    rows = catalog.select("cat_id", T.norm_key(F.col("author")).alias("ca_key"), T.norm_key(narrator).alias("cn_key"),
                          F.explode(T.title_variants(F.coalesce("title", F.lit("")))).alias("__v")).select(
        "cat_id", T.norm_key(F.col("__v")).alias("rkey"), "ca_key", "cn_key").distinct()
    rank = F.row_number().over(Window.partitionBy("rkey", "ca_key", "cn_key").orderBy("cat_id"))
    return rows.withColumn("__n", rank).filter(F.col("__n") <= keep).groupBy("rkey", "ca_key", "cn_key").agg(
        F.collect_list("cat_id").alias("ids"))


def scored_candidates(hints: DataFrame, catalog: DataFrame, floor: float = THRESHOLD, keep: int = 8, best: int = 0, margin: float | None = None) -> DataFrame:
    """(key, a_key, n_key, cat_id, score) with score >= ``floor`` for the distinct hints; entries behind the ``best`` ones of a
    hint, or by more than ``margin`` behind its first, may be left out.

    Equal hints and equal entries are one row each before anything is paired, and a pair is dropped as soon as bounds on its
    title, author and narrator show that it misses the floor (``scored_pairs``). A narrator that agrees by more than 85 adds 5 points, up to 100. Of entries that agree in title, author and
    narrator the ``keep`` smallest ids stand for all, as all score alike.
    """
    entries = cut_lineage(_entry_groups(catalog, keep))
    scored = scored_pairs(hints, entries, floor, best=best, margin=margin)
    return scored.join(entries, ["rkey", "ca_key", "cn_key"]).select(*HINT, F.explode("ids").alias("cat_id"), "score").groupBy(
        *HINT, "cat_id").agg(F.max("score").alias("score"))


def ambiguous_match(items: DataFrame, catalog: DataFrame, floor: float = THRESHOLD, margin: float = 0.5) -> DataFrame:
    """Per item its best entry, and whether two or more different entries lie within ``margin`` of the top."""
    hints = cut_lineage(hint_keys(items))
    scored = cut_lineage(scored_candidates(hints, catalog, floor, margin=margin))
    best = scored.groupBy(*HINT).agg(F.max("score").alias("top"), F.min_by("cat_id", F.struct((-F.col("score")).alias("s"), "cat_id")).alias("best_id"))
    near = scored.join(best, HINT).filter(F.col("score") >= F.col("top") - margin).groupBy(*HINT, "top", "best_id").agg(F.countDistinct("cat_id").alias("near"))
    return hints.join(near, HINT).select("id", F.col("best_id").alias("cat_id"), F.col("top").alias("score"), (F.col("near") >= 2).alias("ambiguous"))


def top_candidates(items: DataFrame, catalog: DataFrame, k: int = 8, floor: float = THRESHOLD) -> DataFrame:
    """The ``k`` best entries per item, best first."""
    hints = cut_lineage(hint_keys(items))
    order = Window.partitionBy(*HINT).orderBy(F.desc("score"), "cat_id")
    best = scored_candidates(hints, catalog, floor, k, best=k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return hints.join(best, HINT).select("id", "cat_id", "rank", "score")


def link_catalog(items: DataFrame, catalog: DataFrame, title_floor: float = max(THRESHOLD, TITLE_FLOOR)) -> DataFrame:
    """(id, cat_id, score, how) by product id, exact path, near path, then title; each stage sees what is left."""
    ids = catalog.filter(F.coalesce("product_id", F.lit("")) != "").groupBy("product_id").agg(F.max("cat_id").alias("cat_id"))
    by_id = items.join(ids, "product_id").select("id", "cat_id", F.lit(100.0).alias("score"), F.lit("product_id").alias("how"))
    left = items.join(by_id, "id", "left_anti").withColumn("key", T.path_key(F.col("path")))
    paths = catalog.withColumn("key", T.path_key(F.col("path"))).filter("key <> ''").groupBy("key").agg(F.max("cat_id").alias("cat_id"))
    by_path = left.join(paths, "key").select("id", "cat_id", F.lit(100.0).alias("score"), F.lit("path").alias("how"))
    left = cut_lineage(left.join(by_path, "id", "left_anti"))
    near = near_keys(left, paths).join(paths.withColumnRenamed("key", "rkey"), "rkey")
    best = near.groupBy("lkey").agg(F.max_by(F.struct("cat_id", "ratio"), F.struct("ratio", "rkey")).alias("b"))
    by_near = cut_lineage(left.join(best, left["key"] == best["lkey"]).select("id", "b.cat_id", F.col("b.ratio").alias("score"), F.lit("path~").alias("how")))
    left = left.join(by_near, "id", "left_anti").drop("key")
    by_title = ambiguous_match(left, catalog, title_floor).select("id", "cat_id", "score", F.lit("title").alias("how"))
    return by_id.unionByName(by_path).unionByName(by_near).unionByName(by_title)


# --- merging -----------------------------------------------------------------------------------------------------------

def fill_in_order(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Per key and field the first non-empty value in ``order``."""
    def first(c):
        value = none_if_blank(F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*[first(c) for c in fields])


def merge_catalogs(catalogs: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """Library files merged by path key, else product id: the earlier file wins, later ones fill what is empty."""
    rows = reduce(DataFrame.unionByName, [c.select(*fields, F.lit(i).alias("source_ord"), F.col("row_ord")) for i, c in enumerate(catalogs)])
    ident = F.coalesce(none_if_blank(T.path_key(F.coalesce("path", F.lit("")))), none_if_blank(F.trim("product_id")))
    keyed = rows.withColumn("ident", ident).filter(F.col("ident").isNotNull()).withColumn("__o", F.struct("source_ord", "row_ord"))
    merged = fill_in_order(keyed, ["ident"], "__o", fields)
    return merged.join(keyed.groupBy("ident").agg(F.min("__o").alias("first_seen")), "ident")


def coalesce_sources(sources: dict[str, DataFrame], fields: Sequence[str], order: Sequence[str] = SOURCE_ORDER, overwrite: bool = False) -> DataFrame:
    """Per id each field from the first source (in order) that has it, with the sources that contributed.

    With ``overwrite`` a later source replaces an earlier value.
    """
    used = [s for s in order if s in sources]
    rows = reduce(DataFrame.unionByName, [sources[s].select("id", *fields, F.lit(-i if overwrite else i).alias("__o"), F.lit(s).alias("__s")) for i, s in enumerate(used)])
    merged = fill_in_order(rows, ["id"], "__o", fields)
    winners = rows.groupBy("id").agg(*[F.min(F.when(none_if_blank(F.col(c)).isNotNull(), F.struct("__o", "__s"))).alias(c) for c in fields])
    gave = F.array_distinct(F.array_compact(F.array(*[F.col(c)["__s"] for c in fields])))
    place = F.array(*[F.lit(s) for s in used])
    return merged.join(winners.select("id", F.array_sort(F.transform(gave, lambda s: F.struct(F.array_position(place, s).alias("n"), s.alias("s")))).alias("__g")), "id").withColumn(
        "contributors", F.transform("__g", lambda g: g["s"])).drop("__g")


def coverage(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Filled values per field (and source), one row each."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in fields])
    return counts.unpivot(list(by) or [F.lit(1).alias("__all")], list(fields), "field", "filled").drop("__all")


def rank_sources(filled: DataFrame) -> DataFrame:
    """Sources by how many values they fill, best first."""
    return filled.groupBy("source").agg(F.sum("filled").alias("filled")).orderBy(F.desc("filled"), "source")


# --- folders and files ---------------------------------------------------------------------------------------------------

FORMAT_FOLDER = r"(?i)^(m4b|m4a|mp4|mp3|flac|ogg|opus|audio|hi-?res|unabridged|abridged)$"
CHAPTER_WORD = r"(?i)\b(chapter|track|episode|section|prologue|epilogue|credits|disc|disk)\b"
PART_TOKEN = r"(?i)[\s._-]*\b(part|pt|cd|disc|disk)\s*\d+\b"
VOLUME = r"(?i)(?:^|[\s._#-])(?:book|bk|vol|volume|#)\s*0*(\d{1,3})\b|(?:^|[\s._-])0*(\d{1,3})(?:[\s._-]|$)"


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def book_folder(path: Column) -> Column:
    """Folder of a file with trailing disc folders (CD1, Disc 2) folded away."""
    return F.regexp_replace(parent_of(path), r"(?i)(?:/(?:cd|disc|disk|part|pt)[\s._-]*\d+)+$", "")


def infer_from_path(path: Column) -> Column:
    """Struct(author, series, title, series_index) from the folder parts of a book's path; a path without parts has the empty title."""
    def parts_of(parts: Column) -> Column:
        def build(c: Column) -> Column:
            s = T.split_series(c["title"])

            def finish(x: Column) -> Column:
                author = F.when(F.size(parts) >= 2, T.clean_title(parts[0])["title"])
                series = F.coalesce(x["series"], F.when(F.size(parts) >= 3, T.clean_title(F.element_at(parts, -2))["title"]))
                series = F.when(T.norm_key(series) != T.norm_key(F.coalesce(author, F.lit(""))), series)
                index = F.coalesce(x["number"], F.when(series != "", c["number"]))
                title = F.when(x["title"] != "", x["title"]).otherwise(F.element_at(parts, -1))
                return F.struct(author.alias("author"), series.alias("series"), title.alias("title"), index.cast("string").alias("series_index"))
            return let(s, finish)
        return let(T.clean_title(F.element_at(parts, -1)), build)
    named = let(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(p))
    return let(named, parts_of)


def album_key(album: Column) -> Column:
    """Which-book identity of an album tag: edition and trailing part number removed, lower case."""
    t = F.trim(F.regexp_replace(F.coalesce(album, F.lit("")), r"(?i)\s*[\(\[]?unabridged[\)\]]?\s*$", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)[\s,;:_-]+\b(part|pt|book|vol|volume|disc|disk|cd)\s*\d+\s*$", ""))
    return none_if_blank(F.lower(t))


def volume_of(stem: Column) -> Column:
    clean = F.regexp_replace(stem, PART_TOKEN, " ")
    a, b = F.regexp_extract(clean, VOLUME, 1), F.regexp_extract(clean, VOLUME, 2)
    text = F.when(a != "", a).when(b != "", b)
    return text.cast("int")


def group_files(files: DataFrame) -> DataFrame:
    """Add ``folder`` and ``book``: which files of a folder are one book.

    files: path, album. Every rule looks at counts over the folder (how many stems carry chapter words, whether
    all share a base, whether volume numbers are all different), so folders are aggregated, never listed:
    distinct album tags split first; chapter wording, a shared tail, "03-17" names, part tokens or a gapless run
    of trailing numbers keep one book; distinct volumes with book words, one-file formats or distinct titles split.
    A given column named like an added one is refused.
    """
    clash = {c.lower() for c in files.columns} & {"folder", "rule", "book"}
    if clash:
        raise ValueError(f"files already have {sorted(clash)}")
    name = name_of(F.col("path"))
    stem = F.regexp_replace("__name", r"(?<=.)\.[^.]*$", "")
    f = files.withColumn("folder", book_folder(F.col("path"))).withColumn("__name", name).withColumn("__stem", stem)
    trail = F.regexp_extract("__stem", r"[\s._#-]*(\d{1,3})\s*$", 1)
    after = F.lower(F.trim(F.regexp_extract("__stem", r"\b\d{1,3}\b[\s._:-]*(.+)$", 1)))
    f = f.withColumns({
        "__album": album_key(F.col("album")), "__chapter": F.col("__stem").rlike(CHAPTER_WORD),
        "__tail": none_if_blank(F.lower(F.trim(F.regexp_extract("__stem", r"^\s*\d{1,3}\s*[-.:_)\s]\s*(.+)$", 1)))),
        "__pair": F.col("__stem").rlike(r"\b\d{1,3}[-_]\d{1,3}\b"), "__base": F.trim(F.regexp_replace("__stem", PART_TOKEN, "")),
        "__part": F.col("__stem").rlike(PART_TOKEN), "__num": F.when(trail != "", trail).cast("int"),
        "__root": F.when(trail != "", F.lower(F.trim(F.regexp_replace("__stem", r"[\s._#-]*(\d{1,3})\s*$", "")))),
        "__tvol": F.col("__stem").rlike(r"(?i)\b(book|vol|volume)\s*\d{1,3}\s*$"), "__vol": volume_of(F.col("__stem")),
        "__word": F.col("__stem").rlike(r"(?i)\b(book|vol|volume)\b"), "__one": F.lower("__name").rlike(r"\.(m4b|m4a|mp4)$"),
        "__after": F.when(after != "", after)})
    one_value = lambda c: F.min(c) == F.max(c)
    g = f.groupBy("folder").agg(
        F.count("*").alias("n"), F.count("__album").alias("albums"), (F.min("__album") != F.max("__album")).alias("many_albums"),
        F.count_if("__chapter").alias("chapters"), ((F.count("__tail") == F.count("*")) & one_value("__tail")).alias("shared_tail"),
        F.count_if("__pair").alias("pairs"), (one_value("__base") & F.max("__part")).alias("parts"),
        ((F.count("__num") == F.count("*")) & one_value("__root") & ~F.min("__tvol")).alias("shared_root"),
        F.min("__num").alias("lo"), F.max("__num").alias("hi"), F.countDistinct("__num").alias("nums"),
        F.countDistinct("__vol").alias("vols"), F.count("__vol").alias("with_vol"), F.max("__word").alias("book_word"), F.min("__one").alias("single_type"),
        F.countDistinct("__after").alias("titles"), F.count("__after").alias("with_title"))
    most = F.greatest(F.lit(2.0), F.col("n") * 0.5)
    gapless = F.col("shared_root") & (F.col("nums") == F.col("n")) & F.col("lo").isin(0, 1) & (F.col("hi") - F.col("lo") == F.col("n") - 1)
    together = (F.col("n") < 2) | (F.col("chapters") >= most) | F.col("shared_tail") | (F.col("pairs") >= most) | F.col("parts") | gapless
    by_volume = (F.col("vols") >= 2) & (F.col("vols") == F.col("with_vol")) & (
        F.col("book_word") | F.col("single_type") | ((F.col("titles") >= 2) & (F.col("titles") == F.col("with_title"))))
    rule = (F.when((F.col("n") >= 2) & (F.col("albums") >= F.greatest(F.lit(2.0), F.col("n") * 0.6)) & F.col("many_albums"), "album")
            .when(F.coalesce(together, F.lit(False)), "one").when(F.coalesce(by_volume, F.lit(False)), "volume").otherwise("one"))
    decided = f.join(g.select("folder", rule.alias("rule")), "folder")
    book = (F.when(F.col("rule") == "album", F.coalesce("__album", F.lower("__name")))
            .when(F.col("rule") == "volume", F.coalesce(F.col("__vol").cast("string"), "__name")).otherwise(""))
    return decided.select(*files.columns, "folder", "rule", book.alias("book"))


def format_variants(books: DataFrame) -> DataFrame:
    """Book folders named only by a format whose parent folder is a book too."""
    parents = books.select(F.col("folder").alias("parent")).distinct()
    return books.select("folder").distinct().filter(name_of(F.col("folder")).rlike(FORMAT_FOLDER)).withColumn(
        "parent", parent_of(F.col("folder"))).join(parents, "parent", "left_semi").select("folder", "parent")


# --- checks ------------------------------------------------------------------------------------------------------------------

def find_duplicates(books: DataFrame) -> DataFrame:
    """Books whose normalised author and title occur at least twice; album, title, then name stand in for each other."""
    pick = lambda *cs: F.coalesce(*[none_if_blank(F.col(c)) for c in cs if c in books.columns], F.lit(""))
    keyed = books.withColumn("dup_key", F.concat_ws("|", T.norm_key(pick("albumartist", "author")), T.norm_key(pick("album", "title", "name"))))
    many = keyed.groupBy("dup_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(many, "dup_key")


def completeness(books: DataFrame) -> DataFrame:
    """Add ``issues`` (missing required fields, then the cover) and ``status`` ok / issues / unknown."""
    lacks = lambda c: none_if_blank(F.col(c)).isNull()
    issues = F.array_compact(F.array(*[F.when(lacks(c), label) for c, label in REQUIRED], F.when(~F.coalesce("has_cover", F.lit(False)), "Missing Cover")))
    known = (~lacks("title") & ~lacks("author")) | ~lacks("product_id")
    return books.withColumn("issues", issues).withColumn(
        "status", F.when(F.size("issues") == 0, "ok").when(known, "issues").otherwise("unknown"))


def track_gaps(files: DataFrame) -> DataFrame:
    """Notes per book and disc whose track numbers are missing or not 1..n; files: book, disc, track.

    Counts decide it: n different numbers from 1 to n.
    """
    disc = F.coalesce(T.first_int(F.col("disc")), F.lit(1))
    per = files.withColumn("__t", T.first_int(F.col("track"))).groupBy("book", disc.alias("disc")).agg(
        F.count("*").alias("n"), F.count("__t").alias("numbered"), F.countDistinct("__t").alias("different"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
    discs = per.groupBy("book").agg(F.count("*").alias("discs"))
    bad = (F.col("different") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n"))
    note = F.when(F.col("numbered") < F.col("n"), "some files have no track number").when(bad, F.concat(F.lit("track numbers are not 1.."), F.col("n").cast("string")))
    label = F.when(F.col("discs") > 1, F.concat(F.lit("disc "), F.col("disc").cast("string"), F.lit(": "))).otherwise("")
    return per.join(discs, "book").filter(F.col("n") >= 2).withColumn("note", F.concat(label, note)).filter(F.col("note").isNotNull()).select("book", "disc", "note")


def run_summary(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("books"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "issues", "unknown")],
                     F.count_if(F.size("issues") > 0).alias("with_issues"), F.count_if(F.col("match_score") < 100).alias("below_100_match"),
                     F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


# --- layout ---------------------------------------------------------------------------------------------------------------------

TEMPLATE = "{author}/{series}/Book {index2} - {title}"
TEMPLATE_NO_SERIES = "{author}/{title}"


def _safe(text: Column) -> Column:
    return let(T.safe_name(text), lambda n: F.coalesce(none_if_blank(n), F.lit("Unknown")))


def _render(template: str, values: dict[str, Column]) -> Column:
    pieces = [values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    text = F.concat(*pieces)
    text = F.regexp_replace(F.regexp_replace(text, r"\s*[-–—]\s*([/\\]|$)", "$1"), r"[/\\]{2,}", "/")
    trimmed = F.filter(F.transform(F.split(text, r"[/\\]"), lambda p: F.btrim(p, F.lit(" -–—,"))), lambda p: p != "")
    named = F.filter(F.transform(trimmed, _safe), lambda p: p != "")
    return let(F.array_join(named, "/"), none_if_blank)


def plan_layout(books: DataFrame, template: str = TEMPLATE, no_series: str = TEMPLATE_NO_SERIES) -> DataFrame:
    """Add ``destination`` from the template; null without title or author. Empty parts collapse."""
    index = T.first_int(F.col("series_index").cast("string"))
    safe = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise(_safe(F.col(c)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in books.columns else F.lit("")
    values = {"author": safe("author"), "title": safe("title"), "series": safe("series"), "index": F.coalesce(index.cast("string"), F.lit("")),
              "index2": F.coalesce(let(index, lambda i: F.when(i < 100, F.lpad(i.cast("string"), 2, "0")).otherwise(i.cast("string"))), F.lit("")),
              "year": text("year"), "asin": text("product_id"), "narrator": text("narrator")}
    known = none_if_blank(F.col("title")).isNotNull() & none_if_blank(F.col("author")).isNotNull()
    rendered = F.when(none_if_blank(F.col("series")).isNotNull(), _render(template, values)).otherwise(_render(no_series, values))
    return books.withColumn("destination", F.when(known, rendered))


def plan(books: DataFrame) -> DataFrame:
    """Put every book into one bucket: held, undetermined, in place, conflict or move.

    books: path, destination, match_score, product_id. Held: a score under 99.5 without an id. Conflict: another
    book targets the same destination in any case. Destinations are counted with a map-side combine.
    """
    held = F.coalesce((F.col("match_score") < 99.5) & none_if_blank(F.col("product_id")).isNull(), F.lit(False))
    inside = F.col("destination").startswith(F.concat("path", F.lit("/")))
    first = (F.when(held, "held").when(F.col("destination").isNull() | inside, "undetermined").when(F.col("destination") == F.col("path"), "in_place"))
    # Made by a generator: filters and join conditions stay above it, so a costly destination is not worked out again for each mention of it.
    staged = books.withColumn("__b", F.explode_outer(F.array(F.struct(first.alias("bucket"), F.lower("destination").alias("low"))))).withColumn(
        "bucket", F.col("__b.bucket"))
    # Only books that may move meet others; those without a destination share no key.
    open_ones = staged.filter(F.col("bucket").isNull()).withColumn("__low", F.col("__b.low"))
    wanted = open_ones.groupBy("__low").agg(F.count("*").alias("__n"))
    moving = open_ones.join(wanted, "__low").withColumn("bucket", F.when(F.col("__n") > 1, "conflict").otherwise("move")).drop("__low", "__n")
    return staged.filter(F.col("bucket").isNotNull()).unionByName(moving).drop("__b")


def plan_accounting(planned: DataFrame) -> DataFrame:
    return planned.groupBy("bucket").agg(F.count("*").alias("books"))


# --- before-images ----------------------------------------------------------------------------------------------------------------

def snapshot(books: DataFrame, fields: Sequence[str], path: str, taken_at: str) -> None:
    """Append one JSON line per book with the managed fields as they are."""
    books.select("id", F.lit(taken_at).alias("taken_at"), *fields).write.mode("append").json(path)


def read_snapshots(spark, path: str, fields: Sequence[str]) -> DataFrame:
    """Snapshot lines; a truncated line is skipped."""
    schema = "id string, taken_at string, " + ", ".join(f"`{f}` string" for f in fields) + ", _broken string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter(F.col("_broken").isNull() & F.col("id").isNotNull()).drop("_broken")


def restore(books: DataFrame, snaps: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Managed fields back to each book's latest snapshot; books without one stay as they are."""
    last = snaps.groupBy("id").agg(F.max_by(F.struct(*fields), "taken_at").alias("__s"))
    out = books.join(last, "id", "left")
    return out.withColumns({f: F.when(F.col("__s").isNotNull(), F.col(f"__s.{f}")).otherwise(F.col(f)) for f in fields}).drop("__s")
