"""Token shards: raw ids in binary files, and a minimal perfect hash index over document keys.

``payload/`` holds the ids alone, little-endian and as narrow as the vocabulary
allows, in ascending document order; each file is one range of document ids.
``documents/`` says where each document lies and ``index/`` holds, for each
bucket of hashed keys, a minimal perfect hash: a few levels of bits, where a key
belongs to the first level on which no other key shares its bit, and its slot is
the number of bits set before. A slot has a stored fingerprint (keys that were
never written are told apart, but for one in 65,536), shard, offset and length, so that a
lookup is a few array reads whatever the number of documents.

Files are written by the tasks that encode; only the table rows of a task that
was committed name its file, so a repeated attempt leaves at most a file nobody names.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from indexwright.llm.automaton import byte_letters, read_vocabulary
from indexwright.llm.chunks import Splitter, TextEncoder
from indexwright.llm.columnar import mixed, small_batches
from indexwright.session import checkpoint_dir

#: Keys of one bucket of the index, on average: what one task builds or reads at once.
BUCKET_KEYS = 50_000
#: Pieces one generation of a worker's memory holds: encoding is all that these workers do.
REMEMBERED = 400_000
#: Bytes of text whose repeated pieces are looked up once.
BLOCK_BYTES = 4 << 20
#: Bytes of payload read at once.
READ_BYTES = 16 << 20
_LEVELS = 64


@dataclass
class TokenStore:
    """A written store: its folder, the id width in bytes and the number of index buckets."""

    spark: SparkSession
    folder: str
    width: int
    buckets: int

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents")

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/shards")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")


def document_key(doc_id: Column, copy: Column) -> Column:
    """The 64-bit key of the n-th row with a document id (0 for the first)."""
    return F.xxhash64(doc_id.cast("string"), copy.cast("int"))


_ENCODERS: dict[tuple[int, str], TextEncoder] = {}


def _encoder(content: str, width: type) -> TextEncoder:
    """The library's own splitter and merges, asked for one new word at a time."""
    key = (hash(content), width.__name__)
    if key not in _ENCODERS:
        splitter, merges = Splitter(content), Tokenizer.from_str(content).model
        letters = {byte: letter for letter, byte in byte_letters().items()}

        def spelled(word: str) -> str:
            if word.isascii() and word.isprintable():
                return word.replace(" ", letters[32])
            return word.encode().decode("latin-1").translate(letters)

        def ids_of(piece: str) -> list[int]:
            return [token.id for word in splitter.words_of(piece) for token in merges.tokenize(spelled(word))]

        _ENCODERS[key] = TextEncoder(splitter, ids_of, width, REMEMBERED, BLOCK_BYTES)
    return _ENCODERS[key]


def write_store(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                folder: str | None = None) -> TokenStore:
    """Encode whole texts, each followed by ``end_id``, into shards in ascending id order.

    A null or empty text has the end id only. Rows that repeat a document id are
    stored one after another and keyed by their number; a null id sorts first.
    Other columns are not read, so their names cannot clash. An empty table makes
    an empty store.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = read_vocabulary(path)
    described = json.loads(content)
    largest = max([end_id, *described["model"]["vocab"].values(), *(t["id"] for t in described["added_tokens"])])
    width = np.uint16 if largest < 1 << 16 else np.uint32
    folder = folder or f"{checkpoint_dir(spark)}/indexwright/tokens-{uuid.uuid4().hex}"
    shared, end = spark.sparkContext.broadcast(content), np.array([end_id], width).tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(f"{where}/payload", recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}.ids"
        encode, position, last, copy, sink = _encoder(shared.value, width), 0, object(), 0, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            parts = [x + end for x in encode(batch.column(1))]
            copies = []
            for i in ids:
                copy = copy + 1 if i == last else 0
                last = i
                copies.append(copy)
            sink = sink or store.open_output_stream(f"{where}/payload/{name}")
            sink.write(b"".join(parts))
            lengths = np.array([len(p) for p in parts], np.int64) // width().itemsize
            positions = position + np.cumsum(lengths) - lengths
            position += int(lengths.sum())
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(copies, pa.int32()), pa.array([shard] * n, pa.int32()),
                 pa.array([name] * n), pa.array(positions), pa.array(lengths)],
                ["doc_id", "copy", "shard", "file", "position", "n_tokens"])
        if sink:
            sink.close()

    ordered = (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    )
    kind = ordered.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(
        written, f"doc_id {kind}, copy int, shard int, file string, position bigint, n_tokens bigint"
    ).withColumn("key", document_key(F.col("doc_id"), F.col("copy"))).write.parquet(f"{folder}/documents")

    rows = spark.read.parquet(f"{folder}/documents")
    # One row for each shard: the running total is over files, not documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard", "file").agg(F.sum("n_tokens").alias("shard_tokens"))
    totals.withColumn("base", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/shards")

    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    entries = rows.select(_bucket(buckets), "key", "shard", "position", "n_tokens")
    entries.groupBy("bucket").applyInArrow(
        _build, "bucket int, sizes array<bigint>, bits binary, prints binary, shards binary, positions binary, lengths binary"
    ).write.parquet(f"{folder}/index")
    return TokenStore(spark, folder, width().itemsize, buckets)


def _uri(folder: str) -> str:
    return folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("key"), F.lit(buckets)).cast("int").alias("bucket")


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(((level + 1) * 0x9E3779B97F4A7C15) % 2**64)
    return (mixed(keys ^ salt) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and all their bits; different keys get different slots."""
    sizes, levels, left = [], [], keys
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("the same key was written twice")
        size = max(8, 2 * len(left))
        spots = _spots(left, len(sizes), size)
        alone = np.bincount(spots, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[spots]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where no level has a bit for it."""
    before = np.concatenate(([0], np.cumsum(bits)))
    found, first = np.full(len(keys), -1, np.int64), 0
    open_ = np.arange(len(keys))
    for level, size in enumerate(sizes):
        spots = _spots(keys[open_], level, size) + first
        hit = bits[spots]
        found[open_[hit]] = before[spots[hit]]
        open_, first = open_[~hit], first + size
    return found


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.uint16)


def _build(bucket: pa.Table) -> pa.Table:
    keys = bucket["key"].to_numpy().view(np.uint64)
    sizes, bits = perfect_hash(keys)
    order = np.argsort(slots(keys, sizes, bits))
    packed = {
        "bits": np.packbits(bits), "prints": _prints(keys)[order], "shards": bucket["shard"].to_numpy()[order],
        "positions": bucket["position"].to_numpy()[order], "lengths": bucket["n_tokens"].to_numpy()[order],
    }
    return pa.table({
        "bucket": pa.array([bucket["bucket"][0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        **{k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()},
    })


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Shard, position and length of each row's ``key`` by the index; unknown keys are left out."""
    asked = keys.select(F.struct("*").alias("row"), "key").withColumn("bucket", _bucket(store.buckets))

    def found(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return asked.select(["row"]).slice(0, 0).append_column("shard", pa.array([], pa.int32())).append_column(
                "position", pa.array([], pa.int64())).append_column("n_tokens", pa.array([], pa.int64()))
        held = {c: index[c][0].as_py() for c in index.column_names}
        bits = np.unpackbits(np.frombuffer(held["bits"], np.uint8))[:sum(held["sizes"])].astype(bool)
        wanted = asked["key"].to_numpy().view(np.uint64)
        at = slots(wanted, held["sizes"], bits)
        prints = np.frombuffer(held["prints"], np.uint16)
        good = np.flatnonzero((at >= 0) & (prints[at] == _prints(wanted)))
        at = at[good]
        return pa.table({
            "row": asked["row"].take(pa.array(good)), "shard": np.frombuffer(held["shards"], np.int32)[at],
            "position": np.frombuffer(held["positions"], np.int64)[at], "n_tokens": np.frombuffer(held["lengths"], np.int64)[at],
        })

    schema = asked.select("row").withColumns({
        "shard": F.lit(0), "position": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema
    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(found, schema)


def read_ids(store: TokenStore, located: DataFrame, result: str, use) -> DataFrame:
    """Read the payload of located rows and hand the ids to ``use``.

    ``located`` has ``row``, ``shard``, ``position`` and ``n_tokens``. Rows of a
    shard are read in file order, neighbours together, in pieces of bounded size.
    ``use(ids, bounds)`` gets a piece's ids and the bounds of each document in
    them, and returns an Arrow array of one ``result`` value for each.
    """
    small_batches(store.spark)
    width = np.dtype(f"<u{store.width}")
    placed = located.join(F.broadcast(store.shards.select("shard", "file", "base")), "shard")
    placed = placed.repartition("shard").sortWithinPartitions("shard", "position").select(
        "row", "file", "position", "n_tokens", "base")
    folder = store.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        opened, source = None, None
        for batch in batches:
            names = batch.column(1).to_pylist()
            positions, lengths = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            first = 0
            while first < len(names):
                end, size = first + 1, int(lengths[first])
                while (end < len(names) and names[end] == names[first] and positions[end] == positions[end - 1] + lengths[end - 1]
                       and (size + lengths[end]) * width.itemsize <= READ_BYTES):
                    size, end = size + int(lengths[end]), end + 1
                if opened != names[first]:
                    if source:
                        source.close()
                    opened, source = names[first], files.open_input_file(f"{where}/payload/{names[first]}")
                data = source.read_at(size * width.itemsize, int(positions[first]) * width.itemsize)
                if len(data) != size * width.itemsize:
                    raise ValueError(f"{opened} is shorter than its index says")
                bounds = np.concatenate(([0], np.cumsum(lengths[first:end])))
                piece = batch.slice(first, end - first)
                starts = pc.add(piece.column(4), piece.column(2))
                values = use(np.frombuffer(data, width), bounds)
                yield pa.RecordBatch.from_arrays([piece.column(0), starts, piece.column(3), values],
                                                 ["row", "start", "n_tokens", "value"])
                first = end
        if source:
            source.close()

    schema = placed.select("row").withColumns({
        "start": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "value": F.lit(None).cast(result)}).schema
    return placed.mapInArrow(read, schema)


def checksums(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """crc32 of each document's ids as little-endian 32-bit numbers."""
    data = memoryview(ids.astype("<u4").tobytes())
    return pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.int64())


def sequences(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each document's ids as a list."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
