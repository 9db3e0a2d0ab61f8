"""BPE encoding and decoding by an automaton over tokens.

The automaton begins with one state and an arc for each byte, so that it accepts
every way of writing a text in bytes. Each merge (a, b) -> c, in order, changes
it by one gadget: the state behind every a-arc is split off and loses its b-arc,
and wherever an a-arc led to a state with a b-arc, a c-arc now leads to where
that b-arc led. After the last merge it accepts one spelling of each text: the
encoding.

States are told apart by the token that was read last, so the gadgets are held
as tables: what each merge cut, and the two halves through which an arc came to
be. An arc is resolved through these tables when it is first met and then kept
in the transition table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexwright.llm.chunks import Splitter, TextEncoder
from indexwright.llm.columnar import ranges, small_batches

#: Resolved arcs one worker keeps; at that number it starts its table anew.
ARCS = 250_000
#: Beginnings of words, of a few bytes, whose labels one worker keeps.
WINDOWS = 75_000
_NEVER = 1 << 62
_WINDOW = 5


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, content: str):
        described = json.loads(content)
        letters, ids = byte_letters(), described["model"]["vocab"]
        self.label = {i: bytes(letters[x] for x in s) for s, i in ids.items()}
        size = max(self.label) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.cuts: dict[int, int] = {}
        self.start, self.resolved = size, 0
        self.table: list[dict[int, bool]] = [{} for _ in range(size + 1)]
        self.tokens = {v: i for i, v in self.label.items() if len(v) == 1}
        for rank, merge in enumerate(described["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(rank, ids[a], ids[b], ids[a + b])
        self.longest = max(map(len, self.tokens))
        self.width = {i: len(v) for v, i in self.tokens.items()}
        self._labels_by_letter()
        self.label |= {t["id"]: t["content"].encode() for t in described["added_tokens"]}

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if self.left[c] >= 0:
            raise ValueError(f"two merges make the same token {c}")
        if self._resolve(a, b):  # else no state has the two arcs in a row, and the gadget is empty
            self.left[c], self.right[c], self.rank[c] = a, b, rank
            self.tokens[self.label[c]] = c
            self.cuts[a << 32 | b] = rank

    def _resolve(self, state: int, token: int) -> bool:
        """Whether the state behind one token has an arc for another, by the gadgets so far.

        An arc made by a merge exists if the arc of the merge's left half did when
        the merge came; and none exists that a merge has cut since. A state split
        off by a merge has the arcs, and the cuts, that its right half had then.
        """
        cuts, rank, before = self.cuts, self.rank, _NEVER
        while True:
            end, since = state, _NEVER
            while end >= 0:
                when = cuts.get(end << 32 | token)
                if when is not None and rank[end] < when < since and when <= before:
                    return False
                end, since = self.right[end], rank[end]
            if self.left[token] < 0:
                return True
            token, before = self.left[token], rank[token]

    def arc(self, state: int, token: int) -> bool:
        """A transition from the table, resolved when first met; the start has all arcs."""
        held = self.table[state].get(token)
        if held is None:
            if self.resolved >= ARCS:
                self.table, self.resolved = [{} for _ in self.table], 0
            held = self.table[state][token] = state == self.start or self._resolve(state, token)
            self.resolved += 1
        return held

    def _labels_by_letter(self) -> None:
        """A trie of all labels: (node, byte) -> node, and the token that ends at a node."""
        self.next: dict[int, int] = {}
        self.ending = [-1]
        self.windows: dict[bytes, tuple[list[int], int]] = {}
        for label, token in self.tokens.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.next.get(key, 0)
                if not node:
                    node = self.next[key] = len(self.ending)
                    self.ending.append(-1)
            self.ending[node] = token

    def _walk(self, node: int, letters: bytes, found: list[int]) -> int:
        """Read on from a node: append the tokens that end, return the last node or 0."""
        step, ending = self.next.get, self.ending
        for byte in letters:
            node = step(node << 8 | byte, 0)
            if not node:
                break
            token = ending[node]
            if token >= 0:
                found.append(token)
        return node

    def readable(self, word: bytes, at: int) -> list[int]:
        """Tokens whose labels begin at a place of the word, the longest first.

        What the next few bytes decide is kept in a table; only where labels go on
        is more of the word read.
        """
        window = word[at:at + _WINDOW]
        held = self.windows.get(window)
        if held is None:
            if len(self.windows) >= WINDOWS:
                self.windows.clear()
            found: list[int] = []
            node = self._walk(0, window, found)
            held = self.windows[window] = (found[::-1], node if len(window) == _WINDOW else 0)
        found, node = held
        if node:
            more: list[int] = []
            self._walk(node, word[at + _WINDOW:at + self.longest], more)
            return more[::-1] + found if more else found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Follow arcs, longest labels first; a dead end takes back the last arc.

        The automaton is deterministic and spells each prefix in one way, so no
        place of the word is reached twice.
        """
        path: list[int] = []
        at, n, state, width = 0, len(word), self.start, self.width
        windows, table, readable = self.windows.get, self.table, self.readable
        choices: list[int] | None = None
        while at < n:
            if choices is None:
                choices, node = windows(word[at:at + _WINDOW]) or (None, 1)
                if node:
                    choices = readable(word, at)
            row = table[state]
            for token in choices:
                held = row.get(token)
                if held or held is None and self.arc(state, token):
                    path.append(token)
                    at += width[token]
                    state, choices = token, None
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                last = path.pop()
                at -= width[last]
                state = path[-1] if path else self.start
                choices = readable(word, at)
                choices = choices[choices.index(last) + 1:]
        return path


_BUILT: dict[int, TextEncoder] = {}


def _encoder(content: str) -> TextEncoder:
    """One automaton for each vocabulary in each worker."""
    key = hash(content)
    if key not in _BUILT:
        splitter, automaton = Splitter(content), MergeAutomaton(content)

        def ids_of(chunk: str) -> list[int]:
            return [i for word in splitter.words_of(chunk) for i in automaton.encode(word.encode())]

        _BUILT[key] = TextEncoder(splitter, ids_of, np.int32)
    return _BUILT[key]


def read_vocabulary(path: str) -> str:
    """The content of a vocabulary file, which tasks get from the driver (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of each whole text as an array of integers.

    A null or empty text has no ids. All other columns stay as they are; a column
    of the new name is replaced. Rows are handled one by one, so repeated rows,
    ties and empty tables need no rule.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(read_vocabulary(path))
    kept = docs.drop(into)
    # The text goes last under a reserved name, so that clashing names do no harm.
    framed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _encoder(content.value)
        for batch in batches:
            parts = whole(batch.column(1))
            bounds = np.cumsum([0, *map(len, parts)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row", "ids"])

    out = framed.mapInArrow(encoded, framed.drop("body").withColumn("ids", F.lit(None).cast("array<int>")).schema)
    return out.select("row.*", F.col("ids").alias(into))


def decode(frame: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that arrays of ids spell: the labels of their arcs, one after another.

    Special tokens are spelled out; bytes that are not UTF-8 become U+FFFD; a null
    array or no ids give the empty text. An id the vocabulary lacks is an error.
    """
    spark = frame.sparkSession
    small_batches(spark)
    # The labels are read once, by the driver: no task parses the vocabulary beside its encoder.
    shared = spark.sparkContext.broadcast(_labels(read_vocabulary(path)))
    kept = frame.drop(into)
    framed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"),
                         F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("body"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, at = shared.value
        for batch in batches:
            column = batch.column(1)
            bounds = np.asarray(column.offsets)
            codes = np.asarray(column.values)[bounds[0]:bounds[-1]]
            if len(codes) and (codes.min() < 0 or codes.max() >= len(at) - 1 or (at[codes + 1] == at[codes]).any()):
                raise ValueError("an id is not in the vocabulary")
            widths = at[codes + 1] - at[codes]
            spelled = body[ranges(at[codes], widths)].tobytes()
            ends = np.concatenate(([0], np.cumsum(widths)))[bounds - bounds[0]].tolist()
            texts = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    out = framed.mapInArrow(decoded, framed.drop("body").withColumn("decoded", F.lit(None).cast("string")).schema)
    return out.select("row.*", F.col("decoded").alias(into))


def _labels(content: str) -> tuple[np.ndarray, np.ndarray]:
    """All labels in one array of bytes, and where each begins."""
    described, letters = json.loads(content), byte_letters()
    label = {i: bytes(letters[x] for x in s) for s, i in described["model"]["vocab"].items()}
    label |= {t["id"]: t["content"].encode() for t in described["added_tokens"]}
    parts = [label.get(i, b"") for i in range(max(label) + 1)]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), np.uint8), at
