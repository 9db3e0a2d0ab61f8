"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a word after another mixes three maximum-likelihood
estimates: of the pair, of the word, and of any word at all. The weights of the mix depend
on how often the first word was seen (by powers of two) and are learned by
expectation-maximisation on a tenth of the training documents, whose own counts
are deleted from the estimates meanwhile.

Texts are read once, into blocks: the sorted distinct words of some documents
and the documents as numbers of those words. A block asks the owners of ranges
of hashed words, and of word pairs, how often each of its keys occurs; owners
add up what all blocks counted and answer in the order asked. So a word or pair is sent
once for each block that has it, however frequent it is, and no table of counts
is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from indexwright.llm.columnar import mixed, pieces, small_batches, word_hashes
from indexwright.llm.exact import golomb_decode, golomb_encode
from indexwright.operators.durable import settle

#: Documents whose fold is this are never trained on; those of the second fold train, and tune the weights.
HELD_OUT, TUNING, FOLDS = 0, 1, 10
#: Words of one block (at least one document) and of one owner's share.
BLOCK_TOKENS = 600_000
OWNER_TOKENS = 2_000_000
#: Bits of a hashed word and of a hashed pair. One of a billion words in a billion shares its count; one of 10^12 pairs in 4,000.
WORD_BITS, PAIR_BITS = 60, 52
#: Steps of a doubling by which the estimates of tuning words are grouped.
GRAIN = 4
ROUNDS = 60
_END = np.uint64(0x5851F42D4C957F2D)
_ABSENT = -10_000


def _blocks(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    small_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fold.alias("fold"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    kind = slim.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {True: [], False: []}
        sizes = {True: 0, False: 0}

        def block(tuning: bool) -> pa.RecordBatch:
            nonlocal number
            ids = pa.chunked_array([h[0] for h in held[tuning]], arrow_kind).combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            folds, counts, hashes = (np.concatenate([h[i] for h in held[tuning]]) for i in (1, 2, 3))
            vocabulary, words = np.unique(hashes, return_inverse=True)
            number += 1
            # Byte planes: the high bytes of word numbers are mostly alike.
            planes = words.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            row = [[number], [tuning], [len(hashes)], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                   [folds.astype(np.int8).tobytes()], [counts.astype("<i8").tobytes()], [vocabulary.tobytes()], [planes]]
            types = [pa.int64(), pa.bool_(), pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            held[tuning], sizes[tuning] = [], 0
            return pa.RecordBatch.from_arrays([r if t is None else pa.array(r, t) for r, t in zip(row, types)],
                                              ["block", "tuning", "n_tokens", "ids", "folds", "counts", "vocabulary", "words"])

        for batch in batches:
            for first, end, body, offsets in pieces(batch.column(2)):
                hashes, counts, _, _ = word_hashes(body, offsets)
                # Each text ends with a token of its own.
                hashes, counts = np.insert(hashes, np.cumsum(counts), _END), counts + 1
                folds = batch.column(1).to_numpy()[first:end]
                tune = folds == TUNING
                owner = np.repeat(tune, counts)
                for tuning in (True, False):
                    mine = tune == tuning
                    if mine.any():
                        held[tuning].append((batch.column(0).slice(first, end - first).filter(pa.array(mine)), folds[mine], counts[mine], hashes[owner == tuning]))
                        sizes[tuning] += len(held[tuning][-1][3])
                    if sizes[tuning] >= BLOCK_TOKENS:
                        yield block(tuning)
        for tuning in (True, False):
            if held[tuning]:
                yield block(tuning)

    return slim.mapInArrow(made, f"block bigint, tuning boolean, n_tokens bigint, ids array<{kind.simpleString()}>, "
                                 "folds binary, counts binary, vocabulary binary, words binary")


@dataclass
class Block:
    """A block's arrays: per document folds and counts, per token word numbers."""

    folds: np.ndarray
    counts: np.ndarray
    vocabulary: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        planes = np.frombuffer(row["words"], np.uint8).reshape(4, -1)
        return cls(np.frombuffer(row["folds"], np.int8), np.frombuffer(row["counts"], "<i8"),
                   np.frombuffer(row["vocabulary"], np.uint64), np.ascontiguousarray(planes.T).view("<u4").ravel())

    def before(self) -> np.ndarray:
        """The number of the word before each token; the end token stands before a text."""
        out = np.empty_like(self.words)
        out[1:] = self.words[:-1]
        out[np.cumsum(self.counts) - self.counts] = np.searchsorted(self.vocabulary, _END)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of word pairs, and the number of each token's pair."""
        joined = mixed(self.vocabulary[self.before()] * np.uint64(0x9FB21C651E98DF25) + self.vocabulary[self.words])
        return np.unique(joined, return_inverse=True)

    def tally(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """How often each key occurs in training documents."""
        return np.bincount(numbers[np.repeat(self.folds, self.counts) != HELD_OUT], minlength=size)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest; the first byte is that number."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or counts.max() < 1 << (8 * w - 1))
    return bytes([width]) + counts.astype(f"<i{width}").tobytes()


def _plain(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def _requests(blocks: DataFrame, owners: int, of_pairs: bool) -> DataFrame:
    """Each block's keys for each owner, Golomb-coded, with its training counts."""
    bits = PAIR_BITS if of_pairs else WORD_BITS
    width = -(-(1 << bits) // owners)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                keys, numbers = block.pairs() if of_pairs else (block.vocabulary, block.words)
                train = block.tally(numbers, len(keys))
                short = (keys >> np.uint64(64 - bits)).astype(np.int64)
                bounds = np.searchsorted(short, np.arange(owners + 1, dtype=np.int64) * width)
                for owner in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[owner], bounds[owner + 1]
                    k, unary, rest = golomb_encode(short[a:b], owner * width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([owner], pa.int32()), pa.array([row["block"]]), pa.array([row["tuning"]]), pa.array([b - a], pa.int32()),
                         pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (unary, rest, _small(train[a:b])))],
                        ["owner", "block", "tuning", "n", "k", "unary", "rest", "train"])

    return blocks.select("block", "tuning", "folds", "counts", "vocabulary", "words").mapInArrow(
        asked, "owner int, block bigint, tuning boolean, n int, k int, unary binary, rest binary, train binary")


def _answers(requests: DataFrame, owners: int, of_pairs: bool) -> DataFrame:
    """For each request the sums over all blocks, in its order, and the owner's totals on one row.

    A tuning block also gets the sums over tuning blocks.
    """
    width = -(-(1 << (PAIR_BITS if of_pairs else WORD_BITS)) // owners)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [golomb_decode(r["n"], r["owner"] * width, r["k"], r["unary"], r["rest"]) for r in rows]
        keys, where = np.unique(np.concatenate(lists), return_inverse=True)
        train, tune, parts, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        for r, keys_asked in zip(rows, lists):
            part, counts = where[at:at + len(keys_asked)], _plain(r["train"])
            np.add.at(train, part, counts)
            if r["tuning"]:
                np.add.at(tune, part, counts)
            parts.append(part)
            at += len(keys_asked)
        n, first = len(rows), [1] + [0] * (len(rows) - 1)
        totals = [int((train > 0).sum()), int(train.sum()), int((train > tune).sum()), int(tune.sum())]
        return pa.table({
            "block": pa.array([r["block"] for r in rows]), "tuning": pa.array([r["tuning"] for r in rows]), "of_pairs": pa.array([of_pairs] * n),
            "owner": table["owner"].cast(pa.int32()), "train": pa.array([_small(train[p]) for p in parts], pa.binary()),
            "tune": pa.array([_small(tune[p]) if r["tuning"] else None for p, r in zip(parts, rows)], pa.binary()),
            **{c: pa.array([t * f for f in first], pa.int64()) for c, t in zip(("types", "tokens", "rest_types", "tune_tokens"), totals)},
        })

    return requests.groupBy("owner").applyInArrow(
        answer, "block bigint, tuning boolean, of_pairs boolean, owner int, train binary, tune binary, "
                "types bigint, tokens bigint, rest_types bigint, tune_tokens bigint")


def _counted(blocks: pa.Table, answers: pa.Table, columns: list[str]) -> tuple[Block, dict[str, np.ndarray]]:
    """A block with, for each token, the counts of its word, of the word before and of the pair."""
    block = Block.of(blocks.select(["folds", "counts", "vocabulary", "words"]).to_pylist()[0])
    held: dict[str, np.ndarray] = {}
    answers = answers.sort_by("owner")
    for of_pairs in (False, True):
        mine = answers.filter(pc.equal(answers["of_pairs"], of_pairs))
        numbers = block.pairs()[1] if of_pairs else block.words
        for column in columns:
            counts = np.concatenate([_plain(x) for x in mine[column].to_pylist()])
            held[("pair_" if of_pairs else "word_") + column] = counts[numbers]
            if not of_pairs:
                held[f"before_{column}"] = counts[block.before()]
    return block, held


def _bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else 1 and the whole part of its binary logarithm."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _estimates(pair: np.ndarray, before: np.ndarray, word: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(before, 1), word / max(tokens, 1)


def _weights(cells: list, types: int) -> np.ndarray:
    """Mixture weights of pair, word and any for each bucket, by expectation-maximisation.

    Cells hold a number of tuning words and their mean estimates. A bucket
    without words gets the weights of all buckets together.
    """
    data = np.array([[c["bucket"], c["n"], c["p2"] / c["n"], c["p1"] / c["n"]] for c in cells], float).reshape(-1, 4)
    any_word = 1.0 / (types + 1)

    def fitted(part: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        if not len(part):
            return weights
        likely = np.column_stack((part[:, 2], part[:, 3], np.full(len(part), any_word)))
        for _ in range(ROUNDS):
            shares = likely * weights
            shares /= shares.sum(axis=1, keepdims=True)
            weights = (shares * part[:, 1:2]).sum(axis=0) + 1e-3
            weights /= weights.sum()
        return weights

    out = np.tile(fitted(data), (65, 1))
    for bucket in np.unique(data[:, 0]).astype(int).tolist():
        out[bucket] = fitted(data[data[:, 0] == bucket])
    return out


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words are runs without the six ASCII spaces, A-Z as a-z, and each text has an
    end token; a null or empty text is its end token alone. Documents whose
    crc32(id) modulo 10 is 0 are held out; a null id counts as the empty text. ``base_score`` is the smoothed
    log10 probability of single words, ``score`` that of the model. Repeated rows
    count as often as they stand. Other columns are not read; an empty table
    gives none.
    """
    blocks = settle(_blocks(docs, text, doc_id), "blocks")
    spark = docs.sparkSession
    size = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_TOKENS))
    words = settle(_answers(_requests(blocks, owners, False), owners, False), "words")
    pairs = settle(_answers(_requests(blocks, owners, True), owners, True), "pairs")
    row = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "rest_types", "tune_tokens")]).first()
    types, tokens, rest_types, tune_tokens = map(int, row)
    answers = words.unionByName(pairs).select("block", "tuning", "of_pairs", "owner", "train", "tune")

    def grouped(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, c = _counted(blocks, answers, ["train", "tune"])
        before = c["before_train"] - c["before_tune"]
        p2, p1 = _estimates(c["pair_train"] - c["pair_tune"], before, c["word_train"] - c["word_tune"], tokens - tune_tokens)
        grain = [np.where(p > 0, np.floor(GRAIN * np.log2(np.where(p > 0, p, 1))), _ABSENT).astype(np.int64) for p in (p2, p1)]
        cells, where = np.unique(np.stack([_bucket(before), *grain], axis=1), axis=0, return_inverse=True)
        where = where.ravel()
        return pa.table({
            "bucket": pa.array(cells[:, 0]), "g2": pa.array(cells[:, 1]), "g1": pa.array(cells[:, 2]), "n": pa.array(np.bincount(where)),
            "p2": pa.array(np.bincount(where, p2)), "p1": pa.array(np.bincount(where, p1))})

    tuning = blocks.filter("tuning").groupBy("block").cogroup(answers.filter("tuning").groupBy("block"))
    cells = tuning.applyInArrow(grouped, "bucket bigint, g2 bigint, g1 bigint, n bigint, p2 double, p1 double")
    # At most 65 buckets and a few hundred steps of each estimate, whatever the corpus.
    weights = _weights(cells.groupBy("bucket", "g2", "g1").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect(), rest_types)
    kind = docs.schema[doc_id].dataType
    arrow_kind = to_arrow_type(kind)

    def scored(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block, c = _counted(blocks, answers, ["train"])
        p2, p1 = _estimates(c["pair_train"], c["before_train"], c["word_train"], tokens)
        bucket = _bucket(c["before_train"])
        model = np.log10(weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] / (types + 1))
        base = np.log10((c["word_train"] + 0.1) / (tokens + 0.1 * (types + 1)))
        starts = np.cumsum(block.counts) - block.counts
        ids = blocks["ids"].combine_chunks()
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        return pa.table({
            "doc_id": ids.cast(arrow_kind), "held_out": pa.array(block.folds == HELD_OUT), "n_tokens": pa.array(block.counts),
            "n_known": pa.array(np.add.reduceat((c["word_train"] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(starts), tokens)),
            "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(model, starts))})

    return blocks.groupBy("block").cogroup(answers.drop("tune").groupBy("block")).applyInArrow(
        scored, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
