"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each part of the table sends every owner of a fingerprint range its sorted distinct
fingerprints, Golomb-Rice coded: a gap costs little more than its logarithm. One bit
each says whether the part itself repeats it, so a text with a third of all rows is
one entry a part. The owner answers each part with a bitmap of those that were sent
more than once or with that bit; there are as many owners as the table's rows need.
Only the texts of these suspects are shuffled, and grouping them by their bytes
decides. Rows that are alike are combined before each shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexwright.llm.columnar import small_batches
from indexwright.operators.durable import settle

#: Bits of a fingerprint: of 10^11 texts, one in 3,000 is a suspect without a copy.
BITS = 48
#: Rows for which one owner is made, which bounds the fingerprints it decodes.
OWNER_ROWS = 2_000_000
_BLANKS = b" \t\n\x0b\x0c\r"


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Sorted whole numbers from ``low`` on: the Rice parameter, unary quotients and remainders."""
    gaps = np.diff(values, prepend=low)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    quotients = gaps >> k
    ones = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    ones[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps & ((1 << k) - 1))[:, None] >> np.arange(k)[None, :] & 1
    return k, np.packbits(ones).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, low: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * k].reshape(n, k).astype(np.int64)
    return low + np.cumsum((quotients << k) + (bits << np.arange(k)[None, :]).sum(axis=1))


def _fingerprints(docs: DataFrame, text: str, doc_id: str, owners: int) -> DataFrame:
    """Rows of two kinds: a document's (part, row, sha256, fingerprint, code points), and a part's messages."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    width = -(-(1 << BITS) // owners)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            digests = [hashlib.sha256(t.encode().translate(None, _BLANKS)).digest() for t in texts]
            prints = np.frombuffer(b"".join(digests), ">u8")[::4].astype(np.uint64) >> np.uint64(64 - BITS)
            prints = prints.astype(np.int64)
            held.append(prints)
            n = len(texts)
            yield _rows(n, doc_id=batch.column(0), part=[part] * n, number=range(row, row + n), sha=[d.hex() for d in digests],
                        print=prints, points=[len(t) for t in texts])
            row += n
        values, copies = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        bounds = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * width)
        for owner in np.flatnonzero(np.diff(bounds)).tolist():
            mine = values[bounds[owner]:bounds[owner + 1]]
            k, unary, rest = golomb_encode(mine, owner * width)
            again = np.packbits(copies[bounds[owner]:bounds[owner + 1]] > 1).tobytes()
            yield _rows(1, part=[part], owner=[owner], n=[len(mine)], k=[k], unary=[unary], rest=[rest], again=[again])

    fields = {"doc_id": slim.schema["doc_id"].dataType, "part": "int", "number": "int", "sha": "string", "print": "bigint",
              "points": "bigint", "owner": "int", "n": "int", "k": "int", "unary": "binary", "rest": "binary", "again": "binary"}
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def _rows(size: int, **given) -> pa.RecordBatch:
        columns = []
        for name, t in fields.items():
            value = given.get(name)
            if name == "doc_id":
                columns.append(value if value is not None else pa.nulls(size, id_type))
            else:
                columns.append(pa.array(value, types[t]) if value is not None else pa.nulls(size, types[t]))
        return pa.RecordBatch.from_arrays(columns, list(fields))

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(slim.schema["doc_id"].dataType)
    schema = ", ".join(f"{c} {kind if c == 'doc_id' else t}" for c, t in fields.items())
    return slim.mapInArrow(sent, schema)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8))[:n].astype(bool)


def _answers(messages: DataFrame, owners: int) -> DataFrame:
    """For each message, a bitmap: which of its fingerprints another part has too, or any part twice."""
    width = -(-(1 << BITS) // owners)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [golomb_decode(r["n"], r["owner"] * width, r["k"], r["unary"], r["rest"]) for r in rows]
        twice = np.concatenate([_bits(r["again"], r["n"]) for r in rows])
        values, where = np.unique(np.concatenate(lists), return_inverse=True)
        again = np.bincount(where, 1 + twice, len(values))[where] > 1
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        maps = [np.packbits(m).tobytes() for m in np.split(again, cuts)]
        return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "owner": pa.array([r["owner"] for r in rows], pa.int32()),
                         "n": pa.array([r["n"] for r in rows], pa.int32()), "bitmap": pa.array(maps, pa.binary())})

    return messages.groupBy("owner").applyInArrow(answer, "part int, owner int, n int, bitmap binary")


def _suspects(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each part reads its bitmaps in fingerprint order: ids of documents that may have a copy."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def marked(rows: pa.Table, answers: pa.Table) -> pa.Table:
        where = np.unique(rows["print"].to_numpy(), return_inverse=True)[1]
        parts = sorted(answers.to_pylist(), key=lambda a: a["owner"])
        again = np.concatenate([_bits(a["bitmap"], a["n"]) for a in parts] or [np.zeros(0, bool)])
        return rows.select(["doc_id"]).filter(pa.array(again[where]))

    return rows.select("doc_id", "part", "print").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(marked, f"doc_id {kind}")


def without_blanks(text: Column) -> Column:
    body = F.coalesce(text.cast("string"), F.lit(""))
    for blank in " \t\n\x0b\x0c\r":
        body = F.replace(body, F.lit(blank), F.lit(""))
    return body


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owners: int | None = None) -> DataFrame:
    """One row for each row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are after all six ASCII spaces are deleted; null is
    the empty text, and all empty texts are one group. The row with the most code
    points stays, then the smallest id (null before all), then, of rows with one
    id and equal length, any one. Other columns are not read. An empty
    table gives none.
    """
    if owners is None:
        owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    stored = settle(_fingerprints(docs, text, doc_id, owners), "fingerprints")
    rows, messages = stored.filter("owner is null"), stored.filter("owner is not null").select("part", "owner", "n", "k", "unary", "rest", "again")
    suspects = _suspects(rows, _answers(messages, owners)).distinct().withColumnRenamed("doc_id", "suspect")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), without_blanks(F.col(f"`{text}`")).alias("bare"))
    texts = texts.join(suspects, F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
    verified = texts.groupBy("bare").count().filter("count > 1").select(F.sha2("bare", 256).alias("sha"), F.col("count").alias("size"))
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id"), F.col("part"), F.col("number")))
    # Copies of one text in one part combine before they are sent on.
    groups = settle(rows.groupBy("sha").agg(best.alias("best")).join(verified, "sha"), "copies")
    joined = rows.join(groups, "sha", "left")
    here = (F.col("part") == F.col("best.part")) & (F.col("number") == F.col("best.number"))
    return joined.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("best").isNull() | here).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``.

    Of rows that repeat an id, those with a kept text stay, one of each text.
    """
    found = settle(exact_groups(docs, text, doc_id), "exact")
    stay = found.filter("kept").groupBy(F.col("doc_id").alias("stay_id")).agg(F.count("*").alias("stay_n"))
    often = found.groupBy(F.col("doc_id").alias("often_id")).count().filter("count > 1")
    held = docs.join(stay.select("stay_id"), docs[doc_id].eqNullSafe(F.col("stay_id")), "left_semi")
    single = held.join(often, held[doc_id].eqNullSafe(F.col("often_id")), "left_anti")
    # Rows that share an id are told apart by their texts.
    shared = held.join(often, held[doc_id].eqNullSafe(F.col("often_id")), "left_semi")
    texts = found.filter("kept").select(F.col("doc_id").alias("stay_id"), "text_sha256")
    marked = shared.withColumn("stay_sha", F.sha2(without_blanks(F.col(f"`{text}`")), 256))
    exact = marked.join(texts, marked[doc_id].eqNullSafe(F.col("stay_id")) & (F.col("stay_sha") == F.col("text_sha256")), "left_semi")
    longest = F.max(F.struct(F.char_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    one = exact.groupBy(F.col(f"`{doc_id}`").alias("stay_id"), "stay_sha").agg(longest.alias("top")).select("top.row.*")
    return single.unionByName(one)
