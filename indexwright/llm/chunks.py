"""Texts to token ids by chunks that repeat, so that most of a text is a table lookup.

A lone space followed by anything but white space always begins a new word of
the byte-level pattern, whatever stands before it. A text without two white
spaces in a row is therefore cut at its spaces, and each piece has ids of its
own; what repeats within a block of such texts is found by Arrow and looked up
once. Other texts are cut by the vocabulary's own splitter.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers.pre_tokenizers import ByteLevel

from indexwright.llm.columnar import ranges

#: Pieces of one generation, unless asked otherwise; a worker remembers the last two generations.
REMEMBERED = 75_000
#: Longer pieces hardly repeat; they are not remembered.
LONGEST_KEPT = 64
#: Bytes of text cut at once, unless asked otherwise; a longer text is cut alone.
BLOCK_BYTES = 1 << 20
#: Two white spaces in a row: Python's white space, spelled out for Arrow.
_RUN = "[\\s\x0b\x1c-\x1f\x85\\pZ]{2}"
_PAIR = re.compile(r"\s\s")
_MARKS = frozenset(".,;:!?")


def _latin(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Splitter:
    """Special strings and words of a byte-level vocabulary file's content."""

    def __init__(self, content: str):
        described = json.loads(content)
        if described["normalizer"] or described["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level vocabularies without a normaliser are supported")
        if described["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a vocabulary that adds a space before texts is not supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in described["added_tokens"]):
            raise ValueError("special strings that depend on their neighbours are not supported")
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        # The library's splitter by itself: the vocabulary need not be read once more for it.
        self.words = ByteLevel(add_prefix_space=False, use_regex=described["pre_tokenizer"].get("use_regex", True)).pre_tokenize_str

    def parts(self, text: str) -> list[str]:
        """The text as special strings and ordinary parts, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.cut.split(text) if p]

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk: a run of Latin letters after at most a space, with a mark behind it or not."""
        bare = chunk[1:] if chunk[0] == " " else chunk
        if _latin(bare):
            return [chunk]
        if bare[-1:] in _MARKS and _latin(bare[:-1]):
            return [chunk[:-1], chunk[-1]]
        return [chunk[a:b] for _, (a, b) in self.words(chunk)]

    def pieces(self, part: str) -> tuple[list[str], list[str]]:
        """Pieces as they are, then pieces that each follow a space, which is left out."""
        if _PAIR.search(part):
            return [part[a:b] for _, (a, b) in self.words(part)], []
        first, *rest = part.split(" ")
        return [first] if first else [], rest


class Remembered(dict):
    """piece -> ids as bytes of a fixed width, computed when first met.

    ``before`` stands before each piece of this table. A mark behind a word and a
    lone line break inside a piece are words of their own, so such a piece is put
    together from the ids of its parts. A full generation becomes the older one, and
    the one before it is forgotten; a piece met again in the older one moves on, so
    frequent pieces are kept.
    """

    def __init__(self, before: str, ids_of: Callable[[str], list[int]], code: str, most: int, bare: Remembered | None = None):
        super().__init__()
        self.most, self.before, self.ids_of, self.code, self.older = most, before, ids_of, code, {}
        #: The table of pieces with nothing before them.
        self.bare = self if bare is None else bare

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            if "\n" in piece:
                first, *rest = lines = piece.split("\n")
                if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                    line, bare = self.bare["\n"], self.bare
                    return self[first] + b"".join([line + bare[x] for x in rest])
            if piece[-1:] in _MARKS and _latin(piece[:-1]):
                value = self[piece[:-1]] + self.bare[piece[-1]]
            else:
                value = array(self.code, self.ids_of(self.before + piece)).tobytes()
            if len(piece) > LONGEST_KEPT:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


class TextEncoder:
    """Ids of whole texts as bytes objects, from a function of one piece.

    Pieces are cut and told apart column by column, so that a piece that repeats
    within a block of texts is looked up once.
    """

    def __init__(self, splitter: Splitter, ids_of: Callable[[str], list[int]], width: type, most: int = REMEMBERED,
                 block: int = BLOCK_BYTES):
        self.splitter, self.width, self.block = splitter, np.dtype(width), block
        self.plain = Remembered("", ids_of, self.width.char, most)
        self.spaced = Remembered(" ", ids_of, self.width.char, most, self.plain)
        self.special = {s: np.array([i], width).tobytes() for s, i in splitter.special.items()}

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text of a column or list without nulls."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, _RUN)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        out = np.empty(len(texts), object)
        out[odd] = [self._in_order(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        plain, ids = texts.filter(pa.array(~odd)), []
        ends = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False), dtype=np.int64)
        first, read = 0, 0
        while first < len(plain):
            end = max(first + 1, int(np.searchsorted(ends, read + self.block, "right")))
            ids += self._cut_at_spaces(plain.slice(first, end - first))
            first, read = end, int(ends[end - 1])
        out[~odd] = ids
        return out.tolist()

    def _in_order(self, text: str) -> bytes:
        """The ids of any text, piece by piece."""
        ids: list[bytes] = []
        for part in self.splitter.parts(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                plain, spaced = self.splitter.pieces(part)
                ids.extend(map(self.plain.__getitem__, plain))
                ids.extend(map(self.spaced.__getitem__, spaced))
        return b"".join(ids)

    def _cut_at_spaces(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts in which each space begins a word, without special strings."""
        cut = pc.split_pattern(texts, " ")
        bounds, pieces = np.asarray(cut.offsets, np.int64), cut.flatten()
        bounds = bounds - bounds[0]
        # A text's first piece has no space before it.
        follows = np.ones(len(pieces), bool)
        follows[bounds[:-1]] = False
        firsts = [self.plain[x] if x else b"" for x in pieces.filter(pa.array(~follows)).to_pylist()]
        repeated = pieces.filter(pa.array(follows)).dictionary_encode()
        values = firsts + list(map(self.spaced.__getitem__, repeated.dictionary.to_numpy(zero_copy_only=False).tolist()))
        which = np.empty(len(pieces), np.int64)
        which[~follows] = np.arange(len(firsts))
        which[follows] = repeated.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(firsts)
        widths = np.fromiter(map(len, values), np.int64, len(values)) // self.width.itemsize
        starts, lengths = (np.cumsum(widths) - widths)[which], widths[which]
        ids = np.frombuffer(b"".join(values), self.width)[ranges(starts, lengths)].tobytes()
        ends = (np.concatenate(([0], np.cumsum(lengths)))[bounds] * self.width.itemsize).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]
