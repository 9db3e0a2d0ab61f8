"""Places of regular-expression matches as SQL expressions, for scans that later steps may explode and filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256
_SPANS = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"


def held(column: Column) -> Column:
    """The same values, computed once a row.

    The optimizer copies an expression into every use of its column, also into
    functions of array elements, where it runs once an element; it does not move one
    that depends on the row's number.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(xs: Column, first: Column) -> Column:
    """``first`` and the sums after each element; for short arrays."""
    return F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def locate(frame: DataFrame, patterns: dict[str, str], hints: dict[str, str], body: str = "body", context: int = 0) -> DataFrame:
    """Add a column for each name: all matches of its pattern in ``body``, leftmost first, not overlapping.

    A match has start and end (code points, end exclusive), its text, and up to
    ``context`` characters before and after it, as far as the matches beside it. The
    hint of a name is a plainer pattern that every text with a match has too.
    Running sums are taken in blocks, so that work follows the number of matches.
    """
    names = list(patterns)
    frame = frame.select("*", *[held(F.when(
        F.col(body).rlike(hints[n]), F.regexp_extract_all(body, F.lit(p), 0))).alias(f"_{n}_hits") for n, p in patterns.items()])
    frame = frame.select("*", *[held(F.when(F.size(f"_{n}_hits") > 0, F.split(body, p, -1))).alias(f"_{n}_gaps") for n, p in patterns.items()])
    # Each gap with the match after it.
    frame = frame.select("*", *[held(F.zip_with(
        F.slice(f"_{n}_gaps", 1, F.size(f"_{n}_hits")), f"_{n}_hits",
        lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long"))).alias(f"_{n}_widths") for n in names])

    def starts(n: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(f"_{n}_widths") - 1) / _BLOCK).cast("int"))
        return _running(F.transform(blocks, lambda b: _sum(F.slice(f"_{n}_widths", b * _BLOCK + 1, _BLOCK))), F.lit(0).cast("long"))

    frame = frame.select("*", *[held(F.when(F.size(f"_{n}_widths") > 0, starts(n))).alias(f"_{n}_starts") for n in names])

    def ends(n: str) -> Column:
        inside = F.transform(F.slice(f"_{n}_starts", 1, F.size(f"_{n}_starts") - 1), lambda s, b: F.slice(
            _running(F.slice(f"_{n}_widths", b * _BLOCK + 1, _BLOCK), s), 2, _BLOCK))
        return F.flatten(inside)

    frame = frame.select("*", *[held(ends(n)).alias(f"_{n}_ends") for n in names])

    def span(n: str, h: Column, i: Column) -> Column:
        end = F.get(f"_{n}_ends", i)
        return F.struct(
            (end - F.char_length(h)).alias("start"), end.alias("end"), h.alias("match"),
            F.right(F.get(f"_{n}_gaps", i), F.lit(context)).alias("before"), F.left(F.get(f"_{n}_gaps", i + 1), F.lit(context)).alias("after"))

    def spans(n: str) -> Column:
        return F.coalesce(F.transform(f"_{n}_hits", lambda h, i: span(n, h, i)), F.array().cast(_SPANS))

    found = [held(spans(n)).alias(n) for n in names]
    kept = [c for c in frame.columns if not any(c == f"_{n}_{x}" for n in names for x in ("hits", "gaps", "widths", "starts", "ends"))]
    return frame.select(*[F.col(f"`{c}`") for c in kept if c not in names], *found)
