"""Title, series, path and similarity functions of the catalogue, as column expressions."""
from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.columns import let, none_if_blank, word_list

DASH = "-–—"
# fixed values: patterns of shelving words
NOISE = (r"(?i)\b(unabridged|abridged|audiobook|audio book|mp3|m4b|cd\s*\d*|disc\s*\d*|part\s*\d+|complete|box\s*set|narrated by .*)\b")
ARTICLE = r"(?i)^(the|a|an)\s+"
LAST_ARTICLE = r"(?i),\s*(the|a|an)$"
BRACKETED = r"\s*[\(\[][^)\]]*[\)\]]"
NUMBER_FIRST = r"(?i)^\s*(?:book|bk|vol|volume|part|#)?\s*0*(\d{1,3})\s*[" + DASH + r"._)]\s*"
SERIES_LAST = r"(?i)[\(\[]?\s*([^\(\)\[\]]+?)\s*(?:,|\s)\s*(?:book|bk|vol|volume|#)\s*(\d{1,3})\s*[\)\]]?\s*$"
SERIES_WORD = r"(?i)\b(series|saga|trilogy|duology|novella?|novel|book|vol|volume|collection|cycle|omnibus|unabridged|abridged)\b"
HEAD_TAIL = r"^(\S.*?\S)\s*(?:[;:,()\[\]]|\s[\x{2013}\x{2014}-]\s)(.*)$"
LAST_NUMBERS = r"(?i)(?:\s*[,;:]?\s*(?:book|bk|vol|volume|#)\s*\d+[\s,;:" + "–—" + r"-]*)+$"
LAST_EDITION = r"(?i)\s*[\(\[][^)\]]*(unabridged|abridged)[^)\]]*[\)\]]\s*$"
AFTER_SERIES = r"(?i)^\s*(?:(?:book|bk|vol|volume|part|#)\s*)?(?:0*\d{1,3}\s*[" + DASH + r":,._]*|[" + DASH + r":,]+)\s*"
GENERIC_SUBTITLE = (r"(?i)^(a|an|the)?\s*(lit ?rpg|gamelit|epic|dark|urban|high|cozy|space)?\s*(litrpg|fantasy|adventure|novel|saga|series|story|audiobook|"
                    r"light novel|progression fantasy|cultivation)(\s+(adventure|novel|saga|series|story|epic))?\s*$")
JUNK = (r"(?i)^\s*(?:unknown|unspecified|untitled|no\s+title|various)(?:\s+(?:album|artist|title|author|track|genre|year))?(?:\s*[\(\[].*?[\)\]])?\s*$"
        r"|^\s*(?:track|audio\s*track|title)\s*\d*\s*$|^\s*<unknown>\s*$")
PRODUCT_ID = r"\b(B0[0-9A-Z]{8})\b"
NUMERIC_ID = r"(?:/pd/[^/\s]*/|\b)(\d{10}|\d{9}[\dXx])\b"
# fixed values: language names
LANGUAGES = {"english": "eng", "spanish": "spa", "french": "fre", "german": "ger", "italian": "ita", "portuguese": "por", "dutch": "dut",
             "russian": "rus", "japanese": "jpn", "chinese": "chi", "korean": "kor", "swedish": "swe", "danish": "dan", "norwegian": "nor",
             "finnish": "fin", "polish": "pol"}


def _accent_table() -> tuple[str, str]:
    """Latin letters whose decomposition is one plain letter plus marks."""
    pairs = []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(code):
                pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def norm_key(text: Column) -> Column:
    """Comparison key: no accents, case, brackets, edition words, articles or punctuation."""
    t = F.lower(strip_accents(F.coalesce(text, F.lit(""))))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, BRACKETED, " "), NOISE, " "))
    t = F.regexp_replace(F.trim(F.regexp_replace(t, LAST_ARTICLE, "")), ARTICLE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]+", " "), r"\s+", " "))


def path_key(path: Column) -> Column:
    return norm_key(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[/ ]+|[/ ]+$", ""), "/", " "))


def clean_title(name: Column) -> Column:
    """Struct(title, number): leading number split off, edition words and empty brackets removed."""
    number = F.regexp_extract(name, NUMBER_FIRST, 1)
    t = F.regexp_replace(F.regexp_replace(name, NUMBER_FIRST, ""), NOISE, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[\(\[]\s*[\)\]]", " "), "_", " ")
    t = F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" " + DASH + "._"))
    return F.struct(F.trim(F.regexp_replace(t, LAST_ARTICLE, "")).alias("title"), F.when(number != "", number).cast("int").alias("number"))


def split_series(title: Column) -> Column:
    """Struct(title, series, number) of "Title (Series, Book 3)"; otherwise the title as it is."""
    edge = F.lit(" " + DASH + ",")
    base = F.btrim(F.regexp_replace(title, SERIES_LAST, ""), edge)
    series = F.btrim(F.regexp_extract(title, SERIES_LAST, 1), edge)
    hit = title.rlike(SERIES_LAST) & (base != "") & (series != "") & (F.length(series) < 80)
    number = F.regexp_extract(title, SERIES_LAST, 2)
    return F.struct(F.when(hit, base).otherwise(title).alias("title"), F.when(hit, series).alias("series"),
                    F.when(hit & (number != ""), F.when(number != "", number).cast("int")).alias("number"))


def strip_title_suffix(title: Column) -> Column:
    """Drop the shelving phrase after the first separator, trailing book numbers and edition brackets."""
    def cut(t: Column) -> Column:
        head, tail = F.regexp_extract(t, HEAD_TAIL, 1), F.regexp_extract(t, HEAD_TAIL, 2)
        t = F.when((head != "") & tail.rlike(SERIES_WORD), head).otherwise(t)
        t = F.btrim(F.regexp_replace(t, LAST_NUMBERS, ""), F.lit(" " + DASH + ",;:"))
        return F.trim(F.regexp_replace(t, LAST_EDITION, ""))
    return F.coalesce(none_if_blank(let(F.trim(title), cut)), title)


def strip_series_prefix(title: Column, series: Column) -> Column:
    """Remove a leading series name that a number or separator follows, then a bare leading number."""
    start = F.ltrim(title)
    rest = F.substring(start, F.length(series) + 1, F.length(start))
    after = F.regexp_replace(rest, AFTER_SERIES, "")
    named = (F.length(F.coalesce(series, F.lit(""))) > 0) & F.lower(start).startswith(F.lower(series)) & rest.rlike(AFTER_SERIES) & (after != "")
    t = F.when(F.coalesce(named, F.lit(False)), F.trim(after)).otherwise(title)
    return let(t, lambda x: F.when(x.rlike(NUMBER_FIRST) & (F.regexp_replace(x, NUMBER_FIRST, "") != ""),
                                   F.trim(F.regexp_replace(x, NUMBER_FIRST, ""))).otherwise(x))


def clean_book_title(title: Column, series: Column, index: Column) -> Column:
    """The book's own title out of a full product title."""
    def pick(original: Column) -> Column:
        numbered = r"#\s*\d+\s*[:\-–—]\s*(.+)$"
        after = F.trim(F.regexp_extract(original, numbered, 1))

        def rest(s: Column) -> Column:
            lead = r"^(\d{1,3})\s*[:\-–—]\s+(.+)$"
            subtitle = F.trim(F.regexp_extract(s, lead, 2))
            bare = F.btrim(s, F.lit(" :" + DASH))
            return (F.when(s == original, original)
                    .when(s.rlike(GENERIC_SUBTITLE), F.when(index.isNotNull(), F.concat(series, F.lit(" "), index.cast("string"))).otherwise(original))
                    .when(s.rlike(lead) & (F.when(s.rlike(lead), F.regexp_extract(s, lead, 1)).cast("int") == index) & (F.length(subtitle) >= 3), subtitle)
                    .when(s.rlike(r"^\d{1,3}\b"), original).when(F.length(bare) >= 3, bare).otherwise(original))
        return (F.when(F.length(after) >= 3, after).when(none_if_blank(series).isNull(), original)
                .otherwise(let(F.trim(strip_series_prefix(original, series)), rest)))
    return let(F.trim(title), pick)


def is_junk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(JUNK) | (F.coalesce(text, F.lit("")) == "")


def without_junk(text: Column) -> Column:
    return F.when(~is_junk(text), text)


def find_product_id(*texts: Column) -> Column:
    """"B0" plus eight capitals or digits in any text, first text first; else a ten-digit id in any text."""
    some = lambda value: F.when(value != "", value)
    return F.coalesce(*[some(F.regexp_extract(F.upper(t), PRODUCT_ID, 1)) for t in texts],
                      *[some(F.upper(F.regexp_extract(t, NUMERIC_ID, 1))) for t in texts])


def norm_language(value: Column) -> Column:
    v = F.lower(F.trim(value))
    known = reduce(lambda acc, kv: acc.when(v == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), ""))
    return F.coalesce(known, F.when(F.length(v) >= 3, F.substring(v, 1, 3)))


def first_int(value: Column) -> Column:
    digits = F.regexp_extract(value, r"\d{1,4}", 0)
    return F.when(digits != "", digits).cast("int")


def first_year(value: Column) -> Column:
    digits = F.regexp_extract(value, r"(1[5-9]\d{2}|20\d{2})", 1)
    return F.when(digits != "", digits).cast("int")


def title_variants(title: Column) -> Column:
    """The title and its plausible "just the book" parts, without repeats."""
    numbered = F.trim(F.regexp_extract(title, r"#\s*\d+\s*[:\-–—]\s*(.+)$", 1))
    pieces = F.split(title, ":")
    tail, head = F.trim(F.element_at(pieces, -1)), F.trim(pieces[0])
    coloned = F.contains(title, F.lit(":"))
    return F.array_distinct(F.array_compact(F.array(
        title, F.when(F.length(numbered) >= 4, numbered), F.when(coloned & (F.length(tail) >= 4), tail),
        F.when(coloned & (F.length(head) >= 4), head))))


# --- similarity, 0 to 100, on normalised keys ---------------------------------------------------------------------

def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of the joint length that an edit script leaves alone; pass columns or bound values, not long expressions."""
    total = F.length(a) + F.length(b)
    return (F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(100.0))
            .otherwise((total - F.levenshtein(a, b)) * F.lit(100.0) / total))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Likeness of the word sets: 100 when one holds the other, else the best of common part and both sides."""
    join = lambda x: F.array_join(x, " ")

    def sets(w: Column) -> Column:
        wa, wb = w["a"], w["b"]
        return F.struct(F.array_sort(F.array_intersect(wa, wb)).alias("c"), F.array_sort(F.array_except(wa, wb)).alias("a"),
                        F.array_sort(F.array_except(wb, wa)).alias("b"))

    def texts(s: Column) -> Column:
        return F.struct(join(s["c"]).alias("c"), join(F.concat(s["c"], s["a"])).alias("a"), join(F.concat(s["c"], s["b"])).alias("b"),
                        ((F.size(s["c"]) > 0) & ((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0))).alias("held"))

    def best(t: Column) -> Column:
        return F.when(t["held"], F.lit(100.0)).otherwise(F.greatest(
            sequence_ratio(t["a"], t["b"]), sequence_ratio(t["c"], t["a"]), sequence_ratio(t["c"], t["b"])))

    def score(p: Column) -> Column:
        words = F.struct(F.array_distinct(word_list(p["a"])).alias("a"), F.array_distinct(word_list(p["b"])).alias("b"))
        return F.when((p["a"] == "") | (p["b"] == ""), F.lit(0.0)).when(p["a"] == p["b"], F.lit(100.0)).otherwise(
            let(let(let(words, sets), texts), best))
    return let(F.struct(a.alias("a"), b.alias("b")), score)


def title_score(a: Column, b: Column) -> Column:
    return token_set_ratio(a, b) * 0.35 + sequence_ratio(a, b) * 0.65


def with_author(score: Column, author_a: Column, author_b: Column) -> Column:
    """An agreeing author (60 or more) counts a quarter, a disagreeing one costs 8 points, a missing one nothing."""
    def adjust(x: Column) -> Column:
        return (F.when((x["a"] == "") | (x["b"] == ""), x["s"]).when(x["l"] >= 60, x["s"] * 0.75 + x["l"] * 0.25)
                .otherwise(F.greatest(F.lit(0.0), x["s"] - 8.0)))

    def measured(p: Column) -> Column:
        return let(F.struct(p["a"].alias("a"), p["b"].alias("b"), p["s"].alias("s"), token_set_ratio(p["a"], p["b"]).alias("l")), adjust)
    text = lambda c: F.coalesce(c, F.lit(""))
    return let(F.struct(text(author_a).alias("a"), text(author_b).alias("b"), score.alias("s")), measured)


def match_score(hint_title: Column, hint_author: Column, title: Column, author: Column) -> Column:
    """Best score of the hint's title over the variants of the other title, adjusted by the author."""
    hint = norm_key(strip_title_suffix(hint_title))
    best = let(hint, lambda h: F.array_max(F.transform(title_variants(title), lambda v: let(norm_key(v), lambda k: title_score(h, k)))))
    return with_author(best, norm_key(hint_author), norm_key(author))


# --- file and folder names -------------------------------------------------------------------------------------------

def natural_key(text: Column) -> Column:
    """Sort key with the length of every digit run before it, so "Part 2" comes before "Part 10", however long the runs."""
    def sized(run: Column) -> Column:
        return let(F.regexp_replace(run, "^0+(?=\\d)", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 6, "0"), d))

    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), sized(r)).otherwise(r)), "")


def safe_name(text: Column, max_length: int = 120) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[/\\]\s*", ", ")
    t = F.btrim(F.replace(F.regexp_replace(t, r'[<>:"|?*\x00-\x1f]', ""), F.lit("  "), F.lit(" ")), F.lit(" ."))
    return F.trim(F.substring(t, 1, max_length))


def title_from_file(stem: Column, author: Column, series: Column) -> Column:
    """Title after the volume number of a file name, leading author removed; else without its series prefix."""
    start = F.trim(stem)
    rest = F.substring(start, F.length(author) + 1, F.length(start))
    led = (F.length(F.coalesce(author, F.lit(""))) > 0) & F.lower(start).startswith(F.lower(author)) & rest.rlike(r"^\s*[-–—:]\s*")
    text = F.when(F.coalesce(led, F.lit(False)), F.regexp_replace(rest, r"^\s*[-–—:]\s*", "")).otherwise(start)

    def pick(t: Column) -> Column:
        after = F.trim(F.regexp_extract(t, r"(?:^|[\s–—:_-])(\d{1,3})[\s–—:._-]+(.+)$", 2))
        short = F.btrim(strip_series_prefix(t, series), F.lit(" :" + DASH))
        return (F.when(F.length(after) >= 2, after).when((F.coalesce(series, F.lit("")) != "") & (F.length(short) >= 2), short).otherwise(F.trim(t)))
    return let(text, pick)
