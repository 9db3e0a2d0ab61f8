"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch fills its bins in rounds. In round i each shingle of a document is
hashed to one bin with a value of i and a fraction, and a bin keeps its least;
after as many rounds as there are bins, round i of the second half puts every
shingle into bin i, so all bins fill. Most documents are done after the first
rounds, in time linear in their length, and two sketches agree in a bin with the
probability of the sets' similarity, with concentration.

Equal sets are one class. Classes that agree in a band of bins are candidates:
first each with the least class of the band, and then, in bands whose classes
are still in several components, those of different components whose whole
sketches agree enough. These are compared in blocks of bounded size, and only
what may be a link leaves a block. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.llm.columnar import mixed, pieces, ranges, small_batches, word_hashes
from indexwright.llm.components import components
from indexwright.operators.durable import settle

WORDS = 5
#: Percent of the union that two sets must share, unless a caller says otherwise.
LEAST = 85
#: Bins of a sketch: half of them are in bands, the others serve the estimate only.
BINS = 504
#: Two sets of the least similarity may share no band with this chance.
MISSED = 1.2e-6
#: Classes of one block.
BLOCK = 1000
_WEIGHTS = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(WORDS)]


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text, the sorted hashes of its distinct runs of ``words`` words.

    A text of fewer words has one, of all its words; one without words has none.
    """
    sets: list[np.ndarray] = []
    weights = np.array([_WEIGHTS[i % WORDS] + 2 * (i // WORDS) for i in range(words)], np.uint64)
    for first, end, body, offsets in pieces(column):
        hashes, counts, _, _ = word_hashes(body, offsets)
        runs = max(0, len(hashes) - words + 1)
        sums = np.zeros(runs, np.uint64)
        for i in range(words):
            sums += hashes[i:i + runs] * weights[i]
        sums = mixed(sums)
        at = 0
        for n in counts.tolist():
            if n >= words:
                sets.append(np.unique(sums[at:at + n - words + 1]))
            elif n:
                short = (hashes[at:at + n] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
                sets.append(mixed(np.array([short])))
            else:
                sets.append(np.zeros(0, np.uint64))
            at += n
    return sets


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for each set; rows of empty sets are all ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    filled = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    flat = filled.reshape(-1)
    open_, mine = np.flatnonzero(sizes > 0), shingles
    for turn in range(2 * bins):
        if not len(open_):
            break
        hashed = mixed(mine ^ np.uint64((0xA0761D6478BD642F * (turn + 1)) % 2**64))
        values = np.uint64(turn << 32) | (hashed & np.uint64(0xFFFFFFFF))
        owners = np.repeat(open_, sizes[open_])
        if turn < bins:
            np.minimum.at(flat, owners * bins + ((hashed >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), values)
        else:
            np.minimum.at(flat, owners * bins + (turn - bins), values)
        still = (filled[open_] == np.iinfo(np.uint64).max).any(axis=1)
        if not still.all():
            open_ = open_[still]
            mine = shingles[ranges(starts[open_], sizes[open_])]
    return filled


def banding(least: int = LEAST) -> tuple[int, int]:
    """Bands and rows of a band for ``least`` percent: the longest bands that miss no more than MISSED.

    They take about half of the bins (85: 36 bands of 7; 80: 45 of 6), or as many as they need.
    """
    if not 0 < least <= 100:
        raise ValueError("the least percent must be between 1 and 100")
    for bins in (11 * BINS // 20, BINS):
        for rows in range(BINS // 8, 0, -1):
            agree = min((least / 100) ** rows, 1 - 1e-9)
            count = math.ceil(math.log(MISSED) / math.log1p(-agree))
            if count * rows <= bins:
                return count, rows
    raise ValueError(f"{BINS} bins cannot find sets that share {least} percent")


def maybe(least: int = LEAST) -> float:
    """A pair may be a link if its estimate is not 4.5 standard errors below ``least`` percent."""
    return least / 100 - 4.5 * (least / 100 * (1 - least / 100) / BINS) ** 0.5


def bands(sketches: np.ndarray, least: int = LEAST) -> np.ndarray:
    """One hash for each band of each sketch; the band's number is part of it."""
    count, rows = banding(least)
    out = np.zeros((len(sketches), count), np.uint64)
    for band in range(count):
        held = np.full(len(sketches), band + 1, np.uint64)
        for row in range(rows):
            held = mixed(held * np.uint64(0xE7037ED1A0B428DB) + sketches[:, band * rows + row])
        out[:, band] = held
    return out


def last_bytes(sketches: np.ndarray) -> np.ndarray:
    """Eight bits of each bin, by which two bins are compared."""
    return (mixed(sketches) & np.uint64(0xFF)).astype(np.uint8)


def _maybe(group: pa.Table, least_percent: int) -> pa.Table:
    """Pairs of one block whose sketches agree enough: each pair in the first band they share."""
    band, i, j = (group[c][0].as_py() for c in ("band", "i", "j"))
    chunk = group["chunk"].to_numpy()
    classes, sizes, component = (group[c].to_numpy() for c in ("class", "n", "component"))
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint8).reshape(-1, BINS)
    shared = np.array(group["bands"].to_pylist(), np.int64)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    least = BINS * (maybe(least_percent) * 255 + 1) / 256  # unequal bins agree by chance in one of 256
    a, b = [], []
    for at in left.tolist():
        others = right[right > at] if i == j else right
        others = others[(component[others] != component[at]) & (100 * np.minimum(sizes[others], sizes[at]) >= least_percent * np.maximum(sizes[others], sizes[at]))]
        others = others[(bits[others] == bits[at]).sum(axis=1) >= least]
        first = (shared[others] == shared[at]).argmax(axis=1) if len(others) else others
        for other in others[shared[at][first] == band].tolist():
            x, y = classes[at], classes[other]
            a.append(min(x, y))
            b.append(max(x, y))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def sketched(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``doc_id, row, n_shingles, h1, h2, bands, bits``: a number of the row, the set's 128-bit hash, its bands and bins."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    count, _ = banding(least)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            n = len(sets)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(n, 2)
            filled = sketch(sets)
            found, bits = bands(filled, least).view(np.int64), last_bytes(filled)
            some = np.array([len(s) > 0 for s in sets], bool)
            bounds = np.concatenate(([0], np.cumsum(some * count)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + n)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found[some].ravel())),
                 pa.array([x.tobytes() for x in bits], pa.binary())],
                ["doc_id", "row", "n_shingles", "h1", "h2", "bands", "bits"])
            row += n

    return slim.mapInArrow(made, f"doc_id {kind}, row bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, bits binary")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = classes.join(asked, "class").select("class", F.col("least_id").alias("want_id"), "h1", "h2")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    texts = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["want_id"])).select("class", "body", "h1", "h2")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [s.tobytes() for s in shingle_sets(batch.column(1))]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in stored), np.int64).reshape(-1, 2)
            # Rows that repeat an id may have another text; they are not this class.
            same = (digests[:, 0] == batch.column(2).to_numpy()) & (digests[:, 1] == batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stored, pa.binary())], ["class", "members"]).filter(pa.array(same))

    sets = settle(texts.mapInArrow(whole, "class bigint, members binary").dropDuplicates(["class"]), "sets")
    sides = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("left")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("members").alias("right")), "b").select("a", "b", "left", "right")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                joint = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                good.append(100 * common >= least * (len(joint) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return sides.mapInArrow(similar, "a bigint, b bigint")


def _linked(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """One row for each row: ``doc_id, row, n_shingles, h1, h2``, and ``component, component_id`` of those with shingles."""
    rows = settle(sketched(docs, text, doc_id, least), "sketches")
    full = rows.filter("n_shingles > 0")
    classes = settle(full.groupBy("h1", "h2").agg(
        F.min("row").alias("class"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n")), "classes")
    leaders = full.join(classes.select(F.col("class").alias("row"), "n"), "row").select(F.col("row").alias("class"), "n", "bands", "bits")
    spread = leaders.select("class", "n", F.explode("bands").alias("band"))
    crowded = spread.groupBy("band").agg(F.min("class").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    members = settle(spread.join(crowded, "band"), "crowded")
    sizes = members.filter("class = pivot").select("band", F.col("n").alias("m"))
    first = members.filter("class <> pivot").join(sizes, "band").filter(f"100 * least(n, m) >= {least} * greatest(n, m)").select(
        F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    first = settle(first, "pairs")
    links = settle(_confirmed(first, classes, docs, text, doc_id, least), "links")
    found = components(links, "a", "b")
    # Bands whose classes are still apart: only classes of different components meet, in blocks.
    placed = settle(members.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")).select("band", "class", "n", "component", "size"), "placed")
    apart = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    chunked = placed.join(apart, "band").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.hash("class"), F.col("chunks")))
    blocks = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band", "class", "n", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    full_blocks = blocks.join(leaders.select("class", "bands", "bits"), "class")
    rest = settle(full_blocks.groupBy("band", "i", "j").applyInArrow(lambda group: _maybe(group, least), "a bigint, b bigint").join(first, ["a", "b"], "left_anti"), "pairs")
    more = settle(_confirmed(rest, classes, docs, text, doc_id, least), "links")
    joined = components(links.unionByName(more), "a", "b").withColumnRenamed("node", "class")
    labelled = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(lowest, "component").select("h1", "h2", "component", "component_id")
    ended = rows.join(named, (rows["n_shingles"] > 0) & (rows["h1"] == named["h1"]) & (rows["h2"] == named["h2"]), "left")
    return ended.select("doc_id", "row", "n_shingles", rows["h1"], rows["h2"], "component", "component_id")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row for each row: ``doc_id, n_shingles, component_id, kept``.

    Sets that share ``least`` percent of their union are linked.
    ``component_id`` is the least document id that links of similar sets reach. A
    null, empty or blank text has no shingles and is linked with nothing. Equal
    sets are linked, whatever their order of words; rows that repeat an id are
    each linked by their own text, and a null id is less than none: a component has it only if all its ids are null. Other columns are not
    read. An empty table gives none.
    """
    ended = _linked(docs, text, doc_id, least)
    out = ended.select("doc_id", "n_shingles", F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """One row of each group of ``near_groups`` and all rows without shingles, with all columns.

    The row is one of the group's least document id. Rows that repeat an id or
    have none are judged each by its own set; of those with one id and one set,
    the one of the longest text stands for all.
    """
    ended = settle(_linked(docs, text, doc_id, least), "groups")
    firsts = ended.filter("component is not null and doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("row"))
    verdicts = ended.join(firsts.select("row", F.lit(True).alias("is_first")), "row", "left").withColumn(
        "stays", F.col("component").isNull() | F.coalesce("is_first", F.lit(False)))
    ids = verdicts.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays"))
    stay = ids.filter("n = 1 and stays").select(F.col("doc_id").alias("stay_id"))
    single = docs.join(stay, docs[doc_id] == stay["stay_id"], "left_semi")
    # Rows that share an id are told apart by their sets.
    often = settle(ids.filter("n > 1").select(F.col("doc_id").alias("often_id")), "often")
    shared = docs.filter(F.col(f"`{doc_id}`").isNull()).unionAll(docs.join(often, docs[doc_id] == often["often_id"], "left_semi"))
    framed = shared.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("row_id"),
                           F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    marked = framed.withColumns({"h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "n_shingles": F.lit(0).cast("long")})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(len(sets), 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([len(x) for x in sets], pa.int64())],
                ["row", "row_id", "body", "h1", "h2", "n_shingles"])

    sets = framed.mapInArrow(hashed, marked.schema)
    # Rows without shingles are no copies of one another.
    apart = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    longest = F.max(F.struct(F.char_length("body").alias("n"), "row")).alias("top")
    one = sets.groupBy("row_id", "h1", "h2", apart.alias("apart")).agg(longest)
    want = verdicts.filter("stays").select("doc_id", F.col("h1").alias("a"), F.col("h2").alias("b")).distinct()
    kept = one.join(want, one["row_id"].eqNullSafe(want["doc_id"]) & (one["h1"] == want["a"]) & (one["h2"] == want["b"]), "left_semi")
    return single.unionAll(kept.select("top.row.*"))
