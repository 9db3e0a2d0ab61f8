"""Registered queries of the operators, and SQL where it states the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexwright.llm import (
    alignment, automaton, credentials, exact, interpolation, language, lines, mixing, personal, shards, sketches, spans, whitening,
)
from indexwright.operators.durable import settle
from indexwright.sources.star_quotes import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2).alias("held_out"))
    profiles = language.learn(docs.filter("not held_out").select("text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    store = shards.write_store(docs, VOCABULARY, end_id=0)
    keys = store.documents.select("doc_id", "copy", "key")
    read = shards.read_ids(store, shards.lookup(store, keys), "bigint", shards.checksums)
    return read.select("row.doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op7_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = automaton.encode(docs, VOCABULARY).select("doc_id", "ids")
    both = automaton.decode(coded, VOCABULARY)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = credentials.scan(docs).select("doc_id", "spans")
    ruled = F.filter("spans", lambda s: s["kind"] != "markov")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return spans.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(listed(ruled), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score(table(spark, folder, "documents").select("doc_id", "text"))


def op5_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = spans.removals(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("first").cast("long").alias("first_sentence"),
                        F.col("last").cast("long").alias("last_sentence"), "first_doc_ids")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"))
    mixed = mixing.mix(settle(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = """
WITH s AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
t AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
l AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - 3 * coalesce(CAST(sum(source_size) OVER b AS BIGINT), 0) AS DOUBLE)
             / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER b AS BIGINT), 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY source_size * 3.0 / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT k, source_size, CASE WHEN source_size * 3 <= weight * level THEN CAST(source_size * 3 AS DOUBLE)
             ELSE weight * max(CASE WHEN source_size * 3 > weight * level THEN level END) OVER () END AS target FROM l),
c AS (SELECT *, md5(name) AS h, CASE WHEN size < 4 THEN size
             ELSE length(bin(size)) * 4 + (size >> (length(bin(size)) - 3)) - 4 END AS class FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, substr(h, 1, 2), size, h, name) AS rank FROM c),
o AS (SELECT k, CAST(list_sum(list_transform(range(1, 6), lambda i:
               CAST(instr('0123456789abcdef', substr(md5('offset:' || k), i, 1)) - 1 AS BIGINT) << (4 * (5 - i)))) AS DOUBLE) / 1048576 AS u FROM t),
e AS (SELECT r.*, g.source_size, g.target, o.u, CASE WHEN g.source_size = 0 THEN 0 ELSE g.target / g.source_size END AS x
      FROM r JOIN g USING (k) JOIN o USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(least(floor(rank * x + u) - floor((rank - 1) * x + u), 3) AS BIGINT) * CAST(size AS BIGINT) AS taken FROM e
"""


def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.near_groups(table(spark, folder, "documents").select("doc_id", "text"))


def op9_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def op10_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
q AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM p) WHERE n > 1),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM q, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
j AS (SELECT doc_id, length(x) AS size, CASE
        WHEN len(regexp_extract_all(x, '[|»›•·→]| [>/] ')) >= 3 AND len(regexp_extract_all(x, '[|»›•·→]| [>/] ')) * 30 >= length(x) THEN 1
        WHEN phrases > 0 AND ({lines.ONE_PHRASE} * said >= length(y) OR ({lines.TWO_PHRASES} * said >= length(y) AND phrases > 1)) THEN 1
        WHEN length(x) < 40 AND NOT list_contains(string_split('. ! ? … : ; , " '' ” ’ » ) ] }} * ` 。 ！ ？ ؟ ।', ' '), right(rtrim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    ')), 1)) THEN 1
        WHEN len(regexp_extract_all(x, '[#*$%&|<>~^_=\\\\{{}}]')) * 10 > length(x) THEN 1 ELSE 0 END AS failed
      FROM (SELECT *, length(y) - length(regexp_replace(y, '{lines.PHRASES}', '', 'g')) AS said,
                   len(list_distinct(list_transform(regexp_extract_all(y, '{lines.PHRASES}'), lambda p: regexp_replace(p, ' |s$', '', 'g')))) AS phrases
            FROM (SELECT doc_id, x, lower(x) AS y FROM (SELECT doc_id, unnest(l) AS x FROM w)))),
z AS (SELECT doc_id, sum(size) AS line_chars, sum(size * failed) AS lost FROM j GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             coalesce(line_chars, 0) AS line_chars, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN n USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= {lines.MAX_LOST} * line_chars AS kept FROM m
"""

def op11_galloping_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents").select("doc_id", "text"), VOCABULARY, PIECES)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    made = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(x) for x in made.explained]).cast("array<double>")
    return made.frame.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "place").alias("explained"), F.lit(made.identity_error).cast("double").alias("identity_error"))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find_personal(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(personal.BASE))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(number, personal.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_profiles": op1_language_profiles,
    "op2_token_shards": op2_token_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_mix_sources": op6_mix_sources,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_near_copies": op8_near_copies,
    "op9_exact_copies": op9_exact_copies,
    "op10_line_rules": op10_line_rules,
    "op11_galloping_alignment": op11_galloping_alignment,
    "op12_whitening": op12_whitening,
    "op13_personal_data": op13_personal_data,
}
ORACLES: dict[str, str] = {"op6_mix_sources": OP6_SQL, "op9_exact_copies": OP9_SQL, "op10_line_rules": OP10_SQL}
