"""HTML fragments to plain text."""
from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions.columns import let

ENTITIES = {name: chr(code) for name, code in name2codepoint.items()}
BARE = {k: v for k, v in html5.items() if not k.endswith(";")}
BARE_PATTERN = "^(" + "|".join(sorted(BARE, key=lambda k: (-len(k), k))) + ")"
NAMED = r"^([A-Za-z][A-Za-z0-9]*);"
NUMBERED = r"^#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});?"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _code_point(digits: Column) -> Column:
    code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).cast("int")
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Named and numeric character references; the legacy names also without their semicolon."""
    def one(piece: Column) -> Column:
        name, digits = F.regexp_extract(piece, NAMED, 1), F.regexp_extract(piece, NUMBERED, 1)
        bare = F.regexp_extract(piece, BARE_PATTERN, 1)
        known = F.try_element_at(_table(ENTITIES), name)
        rest = lambda n: F.substring(piece, n + 1, F.length(piece))
        return (F.when((name != "") & known.isNotNull(), F.concat(known, rest(F.length(name) + 1)))
                .when(digits != "", F.concat(_code_point(digits), F.regexp_replace(piece, NUMBERED, "")))
                .when(bare != "", F.concat(F.try_element_at(_table(BARE), bare), rest(F.length(bare))))
                .otherwise(F.concat(F.lit("&"), piece)))

    def join(parts: Column) -> Column:
        return F.concat_ws("", F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)))
    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), join)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Block ends become line breaks, tags go, references are decoded, blanks and blank lines collapse."""
    t = F.regexp_replace(html, r"(?i)<\s*br\s*/?\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</\s*(p|div|li)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.replace(unescape(t), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def html_to_line(html: Column, limit: int = 800) -> Column:
    """One line of text, cut at ``limit`` characters with an ellipsis."""
    t = unescape(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " "))
    t = F.trim(F.regexp_replace(F.replace(t, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))
    return let(t, lambda x: F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x))
