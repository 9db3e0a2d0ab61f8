"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Everything is a SQL expression over one row. Patterns never take a text more than
a bounded number of times: runs are entered at their first character only and are
not given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.llm.matches import held, locate

# What proposes a span. The first four are the base kinds; a run that
# cannot begin a match further in is entered at its beginning, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9/-])",
}
#: A plainer part that every text with a match has.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "ssn": "[0-9]-[0-9]{2}-[0-9]", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "birth_date": "[0-9]{4}-[0-9]{2}-|[0-9][./][0-9]{4}",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
# Characters of a bank account number in each country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
#: What a kind scores by its form alone, after its checksum if it has one.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4, "birth_date": 0.2}
# Words that speak for a kind, in English, French, German and Spanish.
WORDS = {
    "email": "e-?mail|mail|contact|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|client|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta",
    "phone": "phone|tel|telephone|mobile|cell|call|fax|whatsapp|téléphone|portable|telefon|handy|mobil|teléfono|móvil|llame",
    "iban": "iban|account|bank|konto|compte|cuenta|banque|banco",
    "ssn": "ssn|social security|social-security|taxpayer",
    "local_phone": "phone|tel|telephone|mobile|cell|call|fax|whatsapp|téléphone|portable|telefon|handy|mobil|teléfono|móvil|llame",
    "birth_date": "born|birth|birthday|date of birth|dob|né|née|naissance|geboren|geburtsdatum|nacido|nacida|nacimiento",
}
#: Words that speak against every kind: numbers of things.
AGAINST = "order|invoice|isbn|issn|version|build|serial|model|part|ticket|commande|facture|rechnung|bestellung|factura|pedido"
#: Characters beside a span in which words count, what they add or take, and the least score of a kind that is not base.
NEARBY, FOR, LESS, LEAST = 48, 0.3, 0.3, 0.5
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right last digit by Luhn's rule."""
    doubled = F.translate(F.reverse(digits), "0123456789", "0246813579")
    plain = F.reverse(digits)
    places = F.sequence(F.lit(1), F.char_length(digits))
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substring(plain, i, 1)).otherwise(F.substring(doubled, i, 1)).cast("int"))
    return total % 10 == 0


def mod_97(number: Column) -> Column:
    """Whether an account number without spaces leaves 1 when its first four characters go last and letters count from 10."""
    turned = F.concat(F.substring(number, 5, 40), F.substring(number, 1, 4))
    rest = F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), lambda a, i: F.when(
        F.substring(turned, i, 1) >= "A", (a * 100 + F.ascii(F.substring(turned, i, 1)) - 55) % 97,
    ).otherwise((a * 10 + F.substring(turned, i, 1).cast("int")) % 97))
    return rest == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    if kind == "iban":
        number = F.regexp_replace(match, " ", "")
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        return (F.char_length(number) == F.element_at(lengths, F.substring(number, 1, 2))) & mod_97(number)
    if kind == "birth_date":
        years = F.regexp_extract(match, "[0-9]{4}", 0).cast("int")
        return years.between(1900, 2099)
    return F.lit(True)


def _score(kind: str, s: Column) -> Column:
    around = F.lower(F.concat_ws(" | ", s["before"], s["after"]))
    named = around.rlike(rf"(?<!\p{{L}})(?:{WORDS[kind]})(?!\p{{L}})")
    against = around.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})")
    score = F.lit(SCORES[kind]) + F.when(named, FOR).otherwise(0.0) - F.when(against, LESS).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: (start, end, kind, match, score) of personal data, by start, then by kind as in KINDS.

    Of the base kinds (email, ip, card, phone) every match that passes its check is
    there, whatever its score. Other kinds need a score of LEAST, which some reach by
    a checksum and some only with a word for them nearby, and may not overlap a base
    span. Places count code points, the end exclusive. A null or empty text has no
    spans. All columns stay, one named ``spans`` is replaced; repeated rows are
    judged alike and an empty table stays empty. ``spans`` may be exploded and
    filtered: it is computed once a row.
    """
    framed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"]).alias("row"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    found = locate(framed, PATTERNS, HINTS, context=NEARBY)

    def judged(kind: str) -> Column:
        sound = F.filter(kind, lambda s: _confirmed(kind, s["match"]))
        return F.transform(sound, lambda s: F.struct(
            s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["end"], F.lit(kind).alias("kind"), s["match"], _score(kind, s).alias("score")))

    checked = found.select("row", held(F.concat(*map(judged, BASE))).alias("base"), held(F.filter(
        F.concat(*[judged(k) for k in KINDS if k not in BASE]), lambda s: s["score"] >= LEAST)).alias("more"))
    clear = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    ordered = F.array_sort(F.concat("base", clear))
    out = checked.select("row", held(F.transform(ordered, lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], s["score"]))).alias("found"))
    return out.select("row.*", F.col("found").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, the text with each span replaced by its kind in brackets.

    Of overlapping spans the first decides and the rest of what they cover goes with it.
    Null and empty texts, and texts without personal data, stay as they are.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    scanned = find_personal(docs.select(F.struct(*kept).alias("row"), F.col(f"`{text}`").cast("string").alias("body")), "body")
    state = F.aggregate(
        "spans", F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(F.substr("body", a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]")))))
            .otherwise(a["parts"]).alias("parts"),
            F.greatest(a["at"], s["end"]).alias("at")))
    marked = scanned.select("row", "body", held(F.when(F.size("spans") > 0, state)).alias("state"))
    clean = F.when(F.col("state").isNull(), F.col("body")).otherwise(
        F.concat(F.array_join("state.parts", ""), F.substr("body", F.col("state.at").cast("int") + 1)))
    return marked.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
