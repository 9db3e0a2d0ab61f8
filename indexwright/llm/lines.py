"""Line-first cleaning: rules on each line, then a document is judged by what it lost.

Everything is a SQL expression over one row, so documents are neither shuffled
nor sent to Python, and a row's outcome depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.operators.durable import settle

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: A line of fewer characters that ends without a closing mark is a heading or a fragment.
SHORT_LINE = 40
#: A line is navigation with so many separators, one for each so many characters at least.
SEPARATORS, SEPARATOR_CHARS = 3, 30
#: A line is noise if symbols are more than one in so many of its characters.
SYMBOL_CHARS = 10
#: Percent of its characters, blank lines aside, that a document may lose.
MAX_LOST = 50

CLOSING = list(".!?…:;,\"'”’»)]}*`。！？؟।")
SEPARATOR = r"[|»›•·→]|\x20[>/]\x20"
#: Phrases of boilerplate in lower case, as whole words; a licence counts with its name and version.
#: Java and RE2 read them alike, so the SQL of op10 takes them from here.
PHRASES = (
    r"\b(?:(?:all rights reserved|copyright [0-9]{4}|terms of (?:use|service)|privacy policy|cookies?"
    r"|enable javascript|javascript is (?:disabled|required)|click here|read more|sign (?:in|up)|log ?in"
    r"|subscribe|newsletters?|share (?:this|on)|follow us|skip to (?:main )?content|back to top"
    r"|powered by|lorem ipsum|page not found"
    r"|tous droits réservés|mentions légales|en savoir plus|cliquez ici"
    r"|alle rechte vorbehalten|impressum|datenschutzerklärung|nutzungsbedingungen|mehr erfahren|hier klicken"
    r"|todos los derechos reservados|aviso legal|política de privacidad|leer más)\b"
    r"|copyright (?:©|\(c\))|politique de confidentialité|haga clic aquí"
    r"|(?:(?:this|the) (?:work|content|text|page|site|software|code|file|document) (?:is|are|was) )?"
    r"(?:licensed|released|distributed|published) under (?:the |a |an )?(?:terms of the )?"
    r"(?:gnu|gpl|lgpl|agpl|mit|apache|bsd|isc|mozilla|eclipse|cc|creative commons)\b[^.!?]{0,60}(?:\.[0-9][^.!?]{0,20})?)"
)
#: A line is boilerplate if phrases make up one part in so many of it, and with two different phrases one part in so many.
ONE_PHRASE, TWO_PHRASES = 2, 4


def _chars(text: Column) -> Column:
    return F.char_length(text).cast("long")


def line_failures(line: Column) -> Column:
    """Which rule a line with a word fails: punctuation, navigation, boilerplate, or null."""
    size = F.char_length(line)
    last = F.substring(F.rtrim(F.translate(line, "\t\r\x0b\x0c", "    ")), -1, 1)
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>~^_=\\{}]"))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    small = F.lower(line)
    said = F.char_length(small) - F.char_length(F.regexp_replace(small, PHRASES, ""))
    found = F.transform(F.regexp_extract_all(small, F.lit(PHRASES), 0), lambda x: F.regexp_replace(x, " |s$", ""))
    boilerplate = small.rlike(PHRASES) & (
        (ONE_PHRASE * said >= F.char_length(small))
        | ((TWO_PHRASES * said >= F.char_length(small)) & (F.size(F.array_distinct(found)) > 1)))
    return (
        F.when((separators >= SEPARATORS) & (separators * SEPARATOR_CHARS >= size), F.lit("navigation"))
        .when(boilerplate, F.lit("boilerplate"))
        .when((size < SHORT_LINE) & ~last.isin(CLOSING), F.lit("punctuation"))
        .when(symbols * SYMBOL_CHARS > size, F.lit("punctuation"))
    )


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Judge each document by its lines; all rows and columns stay.

    Added: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``clean_text`` (the text without
    failing lines), ``n_lines_removed`` and ``lost_chars``; columns of these names are
    replaced. A null or empty text has no words, fails and keeps what it was as
    ``clean_text``. Blank lines are neither judged nor removed. Repeated rows are
    judged alike; an empty table stays empty.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "clean_text", "n_lines_removed", "lost_chars"]
    kept_columns = [c for c in docs.columns if c not in added]
    framed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    split = framed.select(
        "row", "body", F.filter(F.split("body", SPACES, -1), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    windows = split.withColumn("n", F.size("words")).withColumn(
        "windows",
        F.when(F.col("n") >= 5, F.transform(
            F.sequence(F.lit(0), F.col("n") - 5),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]),
        )).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text with a repeated window sorts its windows, each with its place.
    placed = windows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))

    def same(i: Column, j: Column) -> Column:
        return F.coalesce(F.get("sorted", i)["h"] == F.get("sorted", j)["h"], F.lit(False))

    repeats = placed.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
        lambda i: F.get("sorted", i)["i"],
    ))))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    failing = F.transform("lines", lambda x: F.struct(x.alias("line"), line_failures(x).alias("rule")))
    counted = repeats.select(
        "row", "body", "lines", failing.alias("judged"),
        F.col("n").cast("long").alias("n_words"),
        _chars(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = counted.withColumn("failed", F.transform(F.filter("judged", lambda x: x["rule"].isNotNull()), lambda x: x["line"]))
    lost = failed.select(
        "*",
        F.aggregate("failed", F.lit(0).cast("long"), lambda a, x: a + _chars(x)).alias("lost_chars"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + _chars(x)).alias("line_chars"),
        F.size("failed").cast("long").alias("n_lines_removed"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    clean = F.when(F.col("n_lines_removed") == 0, F.col(f"row.`{text}`")).otherwise(F.array_join(
        F.filter(F.split("body", "\n", -1), lambda x: ~(x.rlike(WORD) & line_failures(x).isNotNull())), "\n"))
    return lost.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("line_chars"))).alias("kept"),
        clean.alias("clean_text"), "n_lines_removed", "lost_chars",
    )


def keep_clean(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows that are kept, with their columns, the text without failing lines.

    ``size``, if there is such a column, becomes the length of a text that lost
    lines. The judged texts are stored once, and the verdict is read from there.
    """
    judged = clean_lines(docs, text)
    changed = {"clean_text": F.when(F.col("kept"), F.col("clean_text"))}
    stored = settle(judged.withColumns(changed).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col("clean_text"), "kept", "n_lines_removed"), "judged")
    out = []
    for field in docs.schema.fields:
        column = F.col("clean_text") if field.name == text else F.col(f"row.`{field.name}`")
        if field.name == size:
            column = F.when(F.col("n_lines_removed") > 0, F.char_length("clean_text")).otherwise(column).cast(field.dataType)
        out.append(column.alias(field.name))
    return stored.filter("kept").select(*out)
