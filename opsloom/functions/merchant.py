"""Bank descriptions to merchant names, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.columns import let, word_list
from opsloom.functions.rules import (
    BRANDS, CITY_WORDS, KEEP_UPPER, NOISE, PREFIXES, PRIME, PROCESSOR, RAW_HINT, STATES, WORDLIKE_STATES, first_match,
)

PREFIX = r"^(?:(?:" + "|".join(PREFIXES) + r")\b[\s:*-]*)+"
NOISE_ANY = "|".join(NOISE)
CITY_STATE = (r"(\S)\s+(?:(?:" + CITY_WORDS + r")\s+)?[A-Z][A-Z.'-]+\s+(?:" + "|".join(STATES) + r")(?:\s+(?:US|USA))?$")
BARE_STATE = r"(\S)\s+(?:" + "|".join(s for s in STATES if s not in WORDLIKE_STATES) + r")$"
EDGE = " -."


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def brand(text: Column) -> Column:
    """Display name of the first brand found in upper-case text, else null."""
    plain = F.regexp_replace(text, PRIME, "~")
    return F.when(plain.rlike(BRANDS[0][0]), F.lit(BRANDS[0][1])).otherwise(first_match(text, BRANDS[1:]))


def _trim_edges(s: Column) -> Column:
    return F.btrim(s, F.lit(EDGE))


def _stripped(text: Column) -> Column:
    s = F.regexp_replace(text, PREFIX, "")
    s = F.regexp_replace(s, PROCESSOR, "")
    s = F.regexp_replace(s, NOISE_ANY, " ")
    s = F.regexp_replace(s, r"[^A-Z0-9&'.+\- ]", " ")
    s = _trim_edges(F.regexp_replace(s, r"\s+", " "))
    s = let(s, lambda x: F.when(F.size(F.split(x, " ")) >= 3, _trim_edges(F.regexp_replace(x, CITY_STATE, "$1"))).otherwise(x))
    return _trim_edges(F.regexp_replace(s, BARE_STATE, "$1"))


def _unbranded(clean: Column) -> Column:
    words = F.slice(word_list(_stripped(clean)), 1, 5)
    named = F.concat_ws(" ", F.transform(words, lambda w: F.when(w.isin(KEEP_UPPER), w).otherwise(_capitalized(w))))
    runs = F.regexp_extract_all(F.substring(clean, 1, 40), F.lit(r"([A-Z]+|[^A-Z]+)"), 1)
    titled = F.concat_ws("", F.transform(runs, _capitalized))
    return let(named, lambda n: F.when(n != "", F.substring(n, 1, 120)).otherwise(titled))


def normalize_merchant(text: Column) -> Column:
    return let(normalize_text(text), lambda clean: F.when(clean == "", F.lit("Unknown")).otherwise(
        F.coalesce(brand(clean), _unbranded(clean))))


def collapse_repeats(name: Column) -> Column:
    """Drop the second copy of the longest leading word group that is repeated at once."""
    def shorten(w: Column) -> Column:
        half = F.floor(F.size(w) / 2).cast("int")
        sizes = F.when(half >= 1, F.sequence(half, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        first = F.try_element_at(F.filter(sizes, lambda n: F.slice(w, F.lit(1), n) == F.slice(w, n + 1, n)), F.lit(1))
        return let(first, lambda n: F.when(n.isNotNull(), F.concat_ws(
            " ", F.concat(F.slice(w, F.lit(1), n), F.slice(w, n * 2 + 1, F.size(w))))))
    return let(name, lambda x: F.coalesce(let(word_list(x), shorten), x))


def tidy_payee(payee: Column) -> Column:
    def tidy(p: Column) -> Column:
        shouting = (p == F.upper(p)) & (p != F.lower(p)) & (F.length(p) > 12)
        name = F.when(F.upper(p).rlike(RAW_HINT) | shouting, normalize_merchant(p)).otherwise(p)
        return F.when(p == "", F.lit("Unknown")).otherwise(F.substring(collapse_repeats(name), 1, 120))
    return let(F.trim(F.regexp_replace(F.coalesce(payee, F.lit("")), r"\s+", " ")), tidy)
