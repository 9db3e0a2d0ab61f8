"""Alignment of two tokenizers' tokens by the byte offsets where both end.

The shorter list of end offsets gallops through the longer one; offsets found in
both cut the tokens into groups, and every pair of tokens in a group is a link. In
how many documents of the corpus an id pair is linked is counted by blocks: a task
tokenises the distinct words of a block of documents once, counts pairs in it, and
sends the block's pairs to where they are added up. The totals go back to the
block, where the words add them up for its documents. So what is shuffled are
pairs of blocks, never of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from indexwright.llm.automaton import byte_letters, read_vocabulary
from indexwright.llm.columnar import ranges
from indexwright.operators.durable import settle

#: Characters of the texts of one block; a longer text is a block of its own.
BLOCK_CHARS = 8_000_000
#: Distinct words tokenised at once.
WORDS_AT_ONCE = 20_000
#: A group with more links than this is linked by its distinct ids, with their numbers.
EXPANDED = 1 << 16
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s\s")


def gallop(short: np.ndarray, long: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each element of ``short`` its place in ``long``, or -1; ``begin`` is where its search starts.

    Both rise, and no element's place is before its start. Steps of 1, 2, 4, ...
    bracket the element, then the bracket is halved; all elements step together.
    """
    if not len(short) or not len(long):
        return np.full(len(short), -1, np.int64)
    last = len(long) - 1
    low, step = begin.astype(np.int64), np.ones(len(short), np.int64)
    high = low.copy()
    open_ = np.flatnonzero(long[high] < short)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step[open_], last)
        step[open_] *= 2
        open_ = open_[(long[high[open_]] < short[open_]) & (low[open_] <= last)]
    low = np.minimum(low, last)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return np.where(long[low] == short, low, -1)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the offsets that are in both; ``first_*`` are the starts of the searches in each list."""
    if len(ends_a) <= len(ends_b):
        place = gallop(ends_a, ends_b, first_b)
        found = np.flatnonzero(place >= 0)
        return found, place[found]
    place = gallop(ends_b, ends_a, first_a)
    found = np.flatnonzero(place >= 0)
    return place[found], found


class _Words:
    """What the words of one block are in both vocabularies: ids, groups, and links as places in a table of pairs."""

    def __init__(self, pair: _Tokenizers):
        self.pair, self.place, self.waiting = pair, {}, []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.sound = [], [], [], [], []
        self.labels: list[str] = []
        self.codes: list[np.ndarray] = []  # links as (a << 32) | b, word by word
        self.times: list[np.ndarray] = []
        self.link_counts: list[np.ndarray] = []

    def __call__(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, each of which stands for a space and what follows it."""
        words = [c[1:] for c in _CUT.split(" " + text)] if text[:1].isspace() or _RUN.search(text) else text.split(" ")
        place = self.place
        out = np.empty(len(words), np.uint32)
        for i, w in enumerate(words):
            k = place.get(w)
            if k is None:
                k = place[w] = len(place)
                self.waiting.append(w)
            out[i] = k
        return out

    def settle(self) -> None:
        """Tokenise the words met since the last time."""
        for i in range(0, len(self.waiting), WORDS_AT_ONCE):
            self._align(self.waiting[i:i + WORDS_AT_ONCE])
        self.waiting = []

    def _align(self, words: list[str]) -> None:
        ids_a, count_a, ids_b, count_b, sound = self.pair.encode(words)
        self.sound += sound
        owner_a, owner_b = np.repeat(np.arange(len(words)), count_a), np.repeat(np.arange(len(words)), count_b)
        ends_a, ends_b = np.cumsum(self.pair.width_a[ids_a]), np.cumsum(self.pair.width_b[ids_b])
        start_a, start_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        at_a, at_b = common_ends(ends_a, ends_b, start_a[owner_b], start_b[owner_a])
        # Differences of the ranks are the sizes of the groups on both sides.
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        owner = owner_a[at_a]
        links = size_a * size_b
        group_a, group_b = at_a + 1 - size_a, at_b + 1 - size_b
        self.n_a.append(count_a)
        self.n_b.append(count_b)
        self.n_groups.append(np.bincount(owner, minlength=len(words)))
        total = np.zeros(len(words), np.int64)
        np.add.at(total, owner, links)
        self.n_links.append(total)
        self.labels += self._labels(ids_a, ids_b, size_a, size_b, owner, len(words))
        small = links <= EXPANDED
        n = np.where(small, links, 0)
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a = ids_a[group_a[which] + step // size_b[which]].astype(np.int64)
        b = ids_b[group_b[which] + step % size_b[which]].astype(np.int64)
        codes, times, of = a << 32 | b, np.ones(len(which), np.int64), owner[which]
        for g in np.flatnonzero(~small):
            ua, ka = np.unique(ids_a[group_a[g]:at_a[g] + 1], return_counts=True)
            ub, kb = np.unique(ids_b[group_b[g]:at_b[g] + 1], return_counts=True)
            codes = np.concatenate((codes, (ua.astype(np.int64)[:, None] << 32 | ub.astype(np.int64)).ravel()))
            times = np.concatenate((times, np.outer(ka, kb).ravel()))
            of = np.concatenate((of, np.full(len(ua) * len(ub), owner[g])))
        if not small.all():
            order = np.argsort(of, kind="stable")
            codes, times, of = codes[order], times[order], of[order]
        self.codes.append(codes)
        self.times.append(times)
        self.link_counts.append(np.bincount(of, minlength=len(words)))

    @staticmethod
    def _labels(ids_a, ids_b, size_a, size_b, owner, n) -> list[str]:
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        out: list[list[str]] = [[] for _ in range(n)]
        i = j = 0
        for w, x, y in zip(owner.tolist(), size_a.tolist(), size_b.tolist()):
            out[w].append((a[i] if x == 1 else ",".join(a[i:i + x])) + "|" + (b[j] if y == 1 else ",".join(b[j:j + y])))
            i += x
            j += y
        return [";".join(x) for x in out]


class _Tokenizers:
    """Both vocabularies, with the bytes of each id."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        spelled_a: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for s, i in self.a.get_vocab().items():
            spelled_a[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        spelled_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                     for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("pieces that go on after a space cannot be aligned word by word")
        self.width_a, self.width_b = (np.array([len(x) for x in s], np.int64) for s in (spelled_a, spelled_b))
        self.body_a, self.body_b = (np.frombuffer(b"".join(s), np.uint8) for s in (spelled_a, spelled_b))
        self.at_a, self.at_b = (np.cumsum(w) - w for w in (self.width_a, self.width_b))
        self.space = self.b.piece_to_id("▁")

    def _one(self, word: str) -> tuple[list[int], list[int]]:
        return self.a.encode(" " + word, add_special_tokens=False).ids, self.b.encode(word) if word else [self.space]

    def _spells(self, ids_a: np.ndarray, ids_b: np.ndarray, text: bytes) -> bool:
        said_a = self.body_a[ranges(self.at_a[ids_a], self.width_a[ids_a])].tobytes()
        return said_a == text and self.body_b[ranges(self.at_b[ids_b], self.width_b[ids_b])].tobytes() == text

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids of all words in both vocabularies, how many each has, and whether they spell the word; others have none.

        Words that end in something are encoded together, as no id of either vocabulary
        goes on from such an end into a space; if that does not spell them, one by one.
        """
        alone = [not w or w[-1].isspace() or "▁" in w for w in words]
        joined = " ".join(w for w, x in zip(words, alone) if not x)
        parts: dict[int, tuple[list[int], list[int]]] = {}
        sound = [True] * len(words)
        together = [k for k, x in enumerate(alone) if not x]
        flat_a = np.array(self.a.encode(" " + joined, add_special_tokens=False).ids if together else [], np.int64)
        flat_b = np.array(self.b.encode(joined) if together else [], np.int64)
        if together and not self._spells(flat_a, flat_b, (" " + joined).encode()):
            alone, together = [True] * len(words), []
            flat_a = flat_b = np.zeros(0, np.int64)
        count_a, count_b = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        stops = np.cumsum([len(words[k].encode()) + 1 for k in together]) if together else np.zeros(0, np.int64)
        for count, flat, width in ((count_a, flat_a, self.width_a), (count_b, flat_b, self.width_b)):
            count[together] = np.diff(np.searchsorted(np.cumsum(width[flat]), stops, "right"), prepend=0)
        for k in np.flatnonzero(alone).tolist():
            a, b = self._one(words[k])
            if self._spells(np.array(a, np.int64), np.array(b, np.int64), (" " + words[k]).encode()):
                parts[k], count_a[k], count_b[k] = (a, b), len(a), len(b)
            else:
                sound[k] = False
        if parts:
            out_a, out_b = np.empty(count_a.sum(), np.int64), np.empty(count_b.sum(), np.int64)
            for out, flat, count, side in ((out_a, flat_a, count_a, 0), (out_b, flat_b, count_b, 1)):
                start = np.cumsum(count) - count
                out[ranges(start[together], count[together])] = flat
                for k, both in parts.items():
                    out[start[k]:start[k] + count[k]] = both[side]
            flat_a, flat_b = out_a, out_b
        return flat_a, count_a, flat_b, count_b, sound


_HELD: dict[int, _Tokenizers] = {}


def _tokenizers(byte_level: str, pieces: bytes) -> _Tokenizers:
    key = hash((byte_level, pieces))
    if key not in _HELD:
        _HELD[key] = _Tokenizers(byte_level, pieces)
    return _HELD[key]


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]
_STORED = ("block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, words binary, "
           "codes array<bigint>, documents array<int>, word_links binary, links binary, times binary")


def _block(pair: _Tokenizers, number: int, keys: pa.Array, texts: list[str | None], names: list[str]) -> pa.RecordBatch:
    """One row for each document of a block, then the block's own row: its pairs and what links each word has."""
    held = _Words(pair)
    numbers = [held(t) if t else np.zeros(0, np.uint32) for t in texts]
    held.settle()
    n_words = len(held.place)
    cat = lambda xs, kind: np.concatenate(xs).astype(kind, copy=False) if xs else np.zeros(0, kind)
    codes, links = np.unique(cat(held.codes, np.int64), return_inverse=True)
    per_word, times = cat(held.link_counts, np.int64), cat(held.times, np.int64)
    at = np.cumsum(per_word) - per_word
    sizes = np.stack([cat(x, np.int64) for x in (held.n_a, held.n_b, held.n_groups, held.n_links)]) if n_words else np.zeros((4, 0), np.int64)
    sound = np.array(held.sound, bool)
    documents = np.zeros(len(codes), np.int32)
    word_mark, pair_mark = np.zeros(n_words, np.int64), np.zeros(len(codes), np.int64)
    totals, digests, kept = [], [], []
    for words in numbers:
        if not len(words) or not sound[words].all():
            totals.append((0, 0, 0, 0))
            digests.append("")
            kept.append(b"")
            continue
        totals.append(sizes[:, words].sum(axis=1).tolist())
        digests.append(hashlib.sha256(";".join([held.labels[k] for k in words.tolist()]).encode()).hexdigest())
        kept.append(words.tobytes())
        # The last place that writes a mark is the one that counts, so that each pair counts once.
        place = np.arange(len(words))
        word_mark[words] = place
        once = words[word_mark[words] == place]
        of = links[ranges(at[once], per_word[once])]
        place = np.arange(len(of))
        pair_mark[of] = place
        documents[of[pair_mark[of] == place]] += 1
    n = len(texts)
    own = [pa.array([number] * (n + 1), pa.int64()), pa.concat_arrays([keys, pa.nulls(1, keys.type)])]
    own += [pa.array([t[k] for t in totals] + [None], pa.int64()) for k in range(4)]
    own += [pa.array([*digests, None], pa.string()), pa.array([*kept, None], pa.binary())]
    for values, kind in ((codes, pa.int64()), (documents, pa.int32())):
        whole = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(values, kind))
        own.append(pa.concat_arrays([pa.nulls(n, whole.type), whole]))
    for values in (per_word.astype(np.uint32), links.astype(np.uint32), times.astype(np.uint32)):
        own.append(pa.array([None] * n + [values.tobytes()], pa.binary()))
    return pa.RecordBatch.from_arrays(own, names)


def _blocks(docs: DataFrame, byte_level: str, pieces: str, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    with open(pieces, "rb") as file:
        held = spark.sparkContext.broadcast((read_vocabulary(byte_level), file.read()))  # two vocabularies, a few MB
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"), F.spark_partition_id().alias("part"))
    schema = _STORED.format(kind=slim.schema["doc_id"].dataType.simpleString())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, size = _tokenizers(*held.value), 0, 0
        keys: list[pa.Array] = []
        texts: list[str | None] = []
        part = 0
        for batch in batches:
            first = 0
            bodies = batch.column(1).to_pylist()
            part = batch.column(2)[0].as_py() if len(bodies) else part
            for i, body in enumerate(bodies):
                size += len(body or "")
                texts.append(body)
                if size >= BLOCK_CHARS:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    yield _block(pair, part << 32 | count, pa.concat_arrays(keys), texts, names)
                    keys, texts, size, first, count = [], [], 0, i + 1, count + 1
            if first < len(bodies):
                keys.append(batch.column(0).slice(first))
        if texts:
            yield _block(pair, part << 32 | count, pa.concat_arrays(keys), texts, names)

    return settle(slim.mapInArrow(made, schema), "aligned")


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``, one row for each row.

    A is the byte-level vocabulary of the tokenizers library, B the pieces of a
    sentencepiece model; both encode the text after a space. ``count_sum`` adds up,
    over all links of a text, in how many texts of the table the pair is linked;
    ``n_best`` counts links whose number is the highest of their A id. Null and empty
    texts, and texts that the ids of one side do not spell, have no tokens: zeros,
    and an empty ``groups_sha256``. Repeated rows, repeated or null ids and ties are
    rows like all others; other columns are not read; an empty table stays empty.
    """
    stored = _blocks(docs, byte_level, pieces, text, doc_id)
    kind = stored.schema["doc_id"].dataType.simpleString()
    pairs = stored.filter("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "documents")).alias("place", "p")).select(
        "block", "place", F.col("p.codes").alias("code"), F.col("p.documents").alias("n")).repartition("code")
    totals = pairs.groupBy("code").agg(F.sum("n").alias("count"))
    # One row for each id of A: no more than its vocabulary has.
    best = totals.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("count").alias("most"))
    known = pairs.select("block", "place", "code").join(totals, "code").withColumn("a", F.shiftright("code", 32)).join(F.broadcast(best), "a")
    answers = known.select(F.col("block").alias("of"), "place", "count", (F.col("count") == F.col("most")).alias("best"))
    documents = stored.select("block", "doc_id", *_COLUMNS, "groups_sha256", "words", "word_links", "links", "times")

    def finished(block: pa.Table, answer: pa.Table) -> pa.Table:
        own = block.column("word_links").is_valid().to_numpy(zero_copy_only=False)
        row = int(np.flatnonzero(own)[0])
        per_word, links, times = (np.frombuffer(block.column(c)[row].as_py(), np.uint32).astype(np.int64) for c in ("word_links", "links", "times"))
        place = answer.column("place").to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = answer.column("count").to_numpy()
        top[place] = answer.column("best").to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(per_word)))
        each = lambda values: np.diff(np.concatenate(([0], np.cumsum(values[links] * times)))[bounds])
        word_count, word_best = each(count), each(top)
        out = block.filter(pa.array(~own)).drop_columns(["block", "word_links", "links", "times"])
        words = [np.frombuffer(w, np.uint32) for w in out.column("words").to_pylist()]
        for name, values in (("n_best", word_best), ("count_sum", word_count)):
            out = out.append_column(name, pa.array([int(values[w].sum()) for w in words], pa.int64()))
        return out.drop_columns(["words"])

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finished, schema)
