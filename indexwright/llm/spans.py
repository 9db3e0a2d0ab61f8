"""Repeated passages: every run of a few sentences is hashed, and later copies are removed.

A run begins at each sentence and takes as many as make up its least number of
sentences and of words. A passage that begins and ends inside sentences may hold
no whole run, so runs of a fixed number of words are added where content chooses
them: of every few neighbouring ones, the one with the least hash. Which one that is
depends on the words of these neighbours alone, so any long enough passage holds
a run that is chosen wherever it stands. Runs that occur again, in another
document or in the same one, are found by joining their hashes over the whole
table; of each run the first document keeps its first occurrence, and every other
is removed. Runs are combined within a document before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.llm.columnar import mixed, pieces, ranges, run_hashes, word_hashes
from indexwright.operators.durable import settle

SENTENCES = 2
WORDS = 16
#: Of so many neighbouring runs of WORDS words one is chosen at least, so WORDS + CHOICE - 1 equal words share one.
CHOICE = 16
_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[[ord(c) for c in "\"')]"]] = True


def _sentence_ends(body: np.ndarray, start: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends a sentence: . ! or ? (a quote or bracket may follow), a line end, or the text's end."""
    last = body[stop - 1]
    closes = _END[last] | (_QUOTE[last] & (stop - start > 1) & _END[body[np.maximum(stop - 2, 0)]])
    lines = np.concatenate(([0], np.cumsum(body == 10)))
    closes[:-1] |= lines[start[1:]] > lines[stop[:-1]]
    closes[ends - 1] = True
    return closes


def _chosen(hashes: np.ndarray, counts: np.ndarray, words: int, choice: int) -> np.ndarray:
    """First words of the chosen runs of ``words`` words: the least hash among ``choice`` neighbours, or of a short text."""
    room = np.maximum(counts - words + 1, 0)
    at = ranges(np.cumsum(counts) - counts, room)
    if not len(at):
        return at
    value = run_hashes(hashes, at, at + words, _BASES[0])
    text = np.repeat(np.arange(len(counts)), room)
    chosen = []
    if len(at) >= choice:
        whole = text[:len(at) - choice + 1] == text[choice - 1:]
        least = np.lib.stride_tricks.sliding_window_view(value, choice)[whole].argmin(axis=1)
        chosen.append(np.flatnonzero(whole) + least)
    short = np.flatnonzero((room > 0) & (room < choice))
    first = (np.cumsum(room) - room)[short]
    chosen.append(np.array([f + value[f:f + n].argmin() for f, n in zip(first.tolist(), room[short].tolist())], np.int64))
    return at[np.unique(np.concatenate(chosen))]


def parts_and_runs(body: np.ndarray, offsets: np.ndarray, least: int = SENTENCES, words: int = WORDS, choice: int = CHOICE):
    """The parts of a piece of texts and their runs, as numbers of parts.

    Parts lie between all places where a sentence or a chosen run begins or ends:
    ``(first word, text number)`` of each, and the byte places of words. Runs:
    first part, last part, and two hashes.
    """
    hashes, counts, start, stop = word_hashes(body, offsets)
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return (none, none, (start, stop)), (none, none, none, none)
    ends = np.cumsum(counts)
    closes = _sentence_ends(body, start, stop, ends[counts > 0])
    end = np.flatnonzero(closes) + 1
    first = np.concatenate(([0], end[:-1]))
    text = np.searchsorted(ends, first, "right")
    begin = np.arange(len(first))
    last = np.maximum(begin + least - 1, np.searchsorted(end, first + words, "left"))
    inside = last < len(first)
    begin, last = begin[inside], last[inside]
    same = text[begin] == text[last]
    chosen = _chosen(hashes, counts, words, choice)
    run_first = np.concatenate((first[begin[same]], chosen))
    run_end = np.concatenate((end[last[same]], chosen + words))
    # A run of sentences may be a chosen run as well.
    both = np.unique(np.stack((run_first, run_end)), axis=1)
    run_first, run_end = both[0], both[1]
    bounds = np.unique(np.concatenate(([0], end, run_first, run_end)))
    parts = bounds[:-1]
    one, two = (run_hashes(hashes, run_first, run_end, base) for base in _BASES)
    runs = (np.searchsorted(bounds, run_first), np.searchsorted(bounds, run_end) - 1, one.view(np.int64),
            (mixed(two) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return (parts, np.searchsorted(ends, parts, "right"), (start, stop)), runs


def document_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", number: str | None = None) -> DataFrame:
    """``doc_id, number, h1, h2, first, last, again``: the runs of each row, by the numbers of their parts.

    ``number`` tells rows apart, whatever their ids; without a column of that
    name they are numbered here, for this one reading. ``again`` marks a run that
    the same row has had before.
    """
    numbers = F.monotonically_increasing_id() if number is None else F.col(f"`{number}`")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"), numbers.alias("number"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, body, offsets in pieces(batch.column(1)):
                (_, owner, _), (begin, last, one, two) = parts_and_runs(body, offsets)
                if not len(begin):
                    continue
                base = np.searchsorted(owner, owner[begin])
                order = np.lexsort((begin, one, owner[begin]))
                repeat = np.zeros(len(begin), bool)
                a, b = order[1:], order[:-1]
                repeat[a] = (one[a] == one[b]) & (owner[begin[a]] == owner[begin[b]])
                rows = pa.array(owner[begin] + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(one), pa.array(two),
                     pa.array((begin - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(repeat)],
                    ["doc_id", "number", "h1", "h2", "first", "last", "again"])

    return slim.mapInArrow(made, f"doc_id {kind}, number bigint, h1 bigint, h2 int, first int, last int, again boolean")


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", number: str | None = None) -> DataFrame:
    """``doc_id, number, first, last, first_doc_id``: every run that is not the first of its text.

    The first is in the row of the least id (null comes last) and, of rows with
    that id, of the least number, where it stands first. Texts are compared word
    by word with A-Z as a-z, whatever the spaces; null and blank texts have no
    sentences. Rows that repeat an id or have none are rows like all others. Other
    columns are not read; an empty table gives none.
    """
    held = settle(document_runs(docs, text, doc_id, number), "runs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("least")
    common = held.filter("not again").groupBy("h1", "h2").agg(F.count("*").alias("n"), least).filter("n > 1").select(
        "h1", "h2", F.col("least.doc_id").alias("first_doc_id"), F.col("least.number").alias("first_number"))
    # Runs that only their own row repeats need no join.
    inside = held.filter("again").select("doc_id", "number", "first", "last", F.col("doc_id").alias("first_doc_id"))
    across = held.filter("not again").join(common, ["h1", "h2"]).filter("number <> first_number").select(
        "doc_id", "number", "first", "last", "first_doc_id")
    return inside.unionByName(across)


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", number: str | None = None) -> DataFrame:
    """``doc_id, number, first, last, first_doc_ids``: the stretches of parts that go, not touching one another.

    ``first_doc_ids`` are the documents that keep the text of a stretch, without
    those that have no id.
    """
    found = settle(repeated_runs(docs, text, doc_id, number), "repeats")
    # Runs of one row only, as whole numbers.
    slots = found.groupBy("number").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    merged = F.aggregate(
        F.slice("runs", 2, F.size("runs")),
        F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.element_at("runs", 1).alias("open")),
        lambda a, r: F.when(r["first"] <= a["open"]["last"] + 1, F.struct(
            a["done"].alias("done"),
            F.struct(a["open"]["first"].alias("first"), F.greatest(a["open"]["last"], r["last"]).alias("last")).alias("open"),
        )).otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), r.alias("open"))),
        lambda a: F.concat(a["done"], F.array(a["open"])))
    stretches = slots.select("doc_id", "number", F.explode(merged).alias("s")).select("doc_id", "number", "s.first", "s.last")
    sources = found.select("number", F.col("first").alias("f"), "first_doc_id")
    matched = stretches.join(sources, "number").filter("f between first and last")
    return matched.groupBy("doc_id", "number", "first", "last").agg(F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns, the text without its removed parts; texts without any stay as they are.

    Of a removed part, what lies up to the next one goes with it. A document
    may end up empty, which is the empty text.
    """
    # Stored once, so that the numbers of the cuts are those of the rows.
    framed = settle(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("row_id"),
        F.col(f"`{text}`").cast("string").alias("body"), F.monotonically_increasing_id().alias("number")), "numbered")
    lists = removals(framed, "body", "row_id", "number").groupBy("number").agg(F.collect_list(F.struct("first", "last")).alias("cut"))
    joined = framed.join(lists, "number", "left").select("row", "body", "cut")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, stretches in enumerate(cuts):
                if stretches and texts[i]:
                    raw = texts[i].encode()
                    (first, _, (start, _)), _ = parts_and_runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    places = np.concatenate((start[first], [len(raw)]))
                    keep = np.ones(len(first), bool)
                    for s in stretches:
                        keep[s["first"]:s["last"] + 1] = False
                    lead = raw[:places[0]]
                    texts[i] = (lead + b"".join(raw[places[k]:places[k + 1]] for k in np.flatnonzero(keep).tolist())).decode() if keep.any() else ""
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "body"])

    out = joined.mapInArrow(cut, joined.select("row", "body").schema)
    return out.select(*[F.col("body").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
