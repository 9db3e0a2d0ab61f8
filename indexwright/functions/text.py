"""Text cleaning: money amounts, dates, identifiers and HTML cells."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns in the order they are tried.
DATE_PATTERNS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy"]


def parse_money(text: Column, strip_code: bool = False) -> Column:
    """Amount text to decimal(18,6); NULL when it is not a plain number.

    The column must be text: a binary float never carries money here.
    """
    marks = "[,₹]|INR" if strip_code else "[,₹]"
    return F.trim(F.regexp_replace(text, marks, "")).try_cast("decimal(18,6)")


def first_date(text: Column) -> Column:
    """The first accepted date pattern that fits, else NULL."""
    cleaned = F.trim(text)
    shapes = {
        "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
        "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
        "dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
        "dd-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    }
    tries = []
    for pattern in DATE_PATTERNS:
        lenient = pattern.replace("dd", "d").replace("MM", "M") if "MMM" not in pattern else "d-MMM-yyyy"
        shaped = F.when(cleaned.rlike(shapes[pattern]), F.initcap(cleaned))
        tries.append(F.try_to_timestamp(shaped, F.lit(lenient)).cast("date"))
    return F.coalesce(*tries)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def keyed(*parts: Column) -> Column:
    """Parts joined with a bar, an unknown part written as a question mark."""
    return F.concat_ws("|", *[F.coalesce(F.nullif(p.cast("string"), F.lit("")), F.lit("?")) for p in parts])


def search_hash(source: Column, route: Column, bucket: Column, travel: Column, collected: Column) -> Column:
    """Identity of one search: source, route, bucket and the two ISO dates."""
    iso = [F.date_format(d, "yyyy-MM-dd") for d in (travel, collected)]
    return F.sha2(F.concat_ws("|", F.trim(source), F.trim(route), F.trim(bucket), *iso), 256)


#: All named characters of HTML as one text to search: mark, name, mark, character, mark.
_NAMES = "\x01" + "\x01".join(f"{name}\x02{char}" for name, char in html.entities.html5.items()) + "\x01"


def _named(name: Column) -> Column:
    """The character (or two) of a name as it stands after the ampersand; NULL for no name."""
    key = F.concat(F.lit("\x01"), name, F.lit("\x02"))
    at = F.instr(F.lit(_NAMES), key)
    usual = F.when(name == "nbsp;", "\u00a0").when(name == "amp;", "&").when(name == "lt;", "<").when(name == "gt;", ">").when(name == "quot;", '"')
    return F.coalesce(usual, F.when((name != "") & (at > 0), F.substring_index(
        F.substr(F.lit(_NAMES), at + F.length(key), F.lit(4)), "\x01", 1)))


def cell_text(cell: Column) -> Column:
    """Tags out, entities decoded, white space collapsed.

    Entities are decoded first of all, or the code of a currency sign that is
    written as a number would become part of the amount.
    """
    bare = F.regexp_replace(cell, "<[^>]+>", " ")
    text = F.when(bare.contains("&"), _unescape(bare)).otherwise(bare)
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def _unescape(text: Column) -> Column:
    """Each piece after an ampersand: a number, a name, or no entity at all."""
    pieces = F.split(text, "&", -1)
    decoded = F.transform(F.slice(pieces, 2, F.size(pieces)), _entity)
    return F.concat(pieces[0], F.array_join(decoded, ""))


def _entity(piece: Column) -> Column:
    """The text after an ampersand with its entity decoded.

    Numbers may have any number of digits and need no semicolon. A name with a
    semicolon is looked up whole; otherwise the longest of the old names, which
    need none, that the piece begins with.
    """
    decimal = F.regexp_extract(piece, "^#([0-9]+);?", 1)
    hexadecimal = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
    name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*;)", 1)
    old = F.regexp_extract(piece, f"^({'|'.join(_old_names())})", 1)
    return (
        F.when(decimal != "", F.concat(_char(decimal, 10), F.regexp_replace(piece, "^#[0-9]+;?", "")))
        .when(hexadecimal != "", F.concat(_char(hexadecimal, 16), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]+;?", "")))
        .when(_named(name).isNotNull(), F.concat(_named(name), F.substr(piece, F.length(name) + 1)))
        .when(old != "", F.concat(_named(old), F.substr(piece, F.length(old) + 1)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def _old_names() -> list[str]:
    """Names that need no semicolon, longest first."""
    return sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


# What numbers of the C1 block stand for (those of windows-1252 where it has a character).
_C1 = {code: bytes([code]).decode("cp1252") for code in range(128, 160) if code not in (129, 141, 143, 144, 157)}


def _char(digits: Column, base: int) -> Column:
    """A code point as a one-character string; none for a control, U+FFFD for one that is not a character."""
    significant = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(significant) > 7, F.lit(0x110000)).otherwise(
        F.coalesce(F.conv(F.nullif(significant, F.lit("")), base, 10).cast("long"), F.lit(0)))
    known = F.substring(F.lit("".join(_C1.get(c, "\x01") for c in range(128, 160))), code.cast("int") - 127, 1)
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(128, 159) & (known != "\x01"), known)
        .when(code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | (code == 11)
              | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 0xFFFE), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )
