"""Alignment of two tokenizers against a token-by-token merge of their ends."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from indexwright.llm import alignment
from indexwright.llm.automaton import byte_letters
from indexwright.llm.queries import PIECES, VOCABULARY

ODD = ["x▁y z", "▁", "  two  spaces ", " lead", "trail ", "tab\tand\nline\n", "a\n\n b", " ", "  ", "\n", "<s> <0x41> <|endoftext|>", "naïve 日本語 😀😀 x",
       "\x00 nul", "　wide　", "\xa0x \x1c y", "'s 't don't", "a" * 700, "日" * 300 + " b", "x \x85 y", "é é"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_letters()
    bytes_a = {i: bytes(letters[c] for c in s) for s, i in a.get_vocab().items() if all(c in letters for c in s)}
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]

    def groups(text):
        if not text:
            return None
        left = [(bytes_a[i], i) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(bytes_b[i], i) for i in b.encode(text)]
        if any(b"".join(s for s, _ in side) != (" " + text).encode() for side in (left, right)):
            return None
        ends = []
        for side in (left, right):
            at, here = 0, []
            for s, _ in side:
                at += len(s)
                here.append(at)
            ends.append(here)
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            out.append(([t for _, t in left[i:x]], [t for _, t in right[j:y]]))
            i, j = x, y
        return out

    return groups


def _brute(groups, rows):
    cut = [(k, groups(t)) for k, t in rows]
    counts = collections.Counter(p for _, g in cut if g for p in {(x, y) for a, b in g for x in a for y in b})
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for k, g in cut:
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((k, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links),
                    hashlib.sha256(spelled.encode()).hexdigest() if g else "", sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [400, alignment.BLOCK_CHARS])
def test_alignment_like_a_merge_of_ends(spark, docs, rows, both, block, monkeypatch):
    texts = [(r[0], r[1]) for r in rows if len(r[1] or "") < 30_000] + [(500 + i, t) for i, t in enumerate(ODD)]
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    frame = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id bigint, text string, words string, block int").repartition(3)
    got = alignment.align(frame, VOCABULARY, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(both, texts)


def test_large_groups_are_linked_by_distinct_ids(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "EXPANDED", 1)
    texts = [(i, t) for i, t in enumerate(ODD + ["ordinary words of a text", "ordinary words again"])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    # Tasks read the module anew, so the bound is tried on the driver.
    pair = alignment._Tokenizers(open(VOCABULARY).read(), open(PIECES, "rb").read())
    batch = alignment._block(pair, 7, __import__("pyarrow").array([i for i, _ in texts]), [t for _, t in texts], [str(k) for k in range(13)])
    monkeypatch.undo()
    plain = alignment._block(pair, 7, __import__("pyarrow").array([i for i, _ in texts]), [t for _, t in texts], [str(k) for k in range(13)])
    for k in range(10):
        assert batch.column(k).equals(plain.column(k))
    assert frame.count() == len(texts)


def test_gallop_finds_what_is_there():
    pick = random.Random(2)
    for _ in range(200):
        long = np.array(sorted(pick.sample(range(500), pick.randrange(1, 80))))
        short = np.array(sorted(pick.sample(range(500), pick.randrange(0, 20))), dtype=np.int64)
        begin = np.array([pick.randrange(0, np.searchsorted(long, x) + 1) if np.searchsorted(long, x) < len(long) else 0 for x in short], dtype=np.int64)
        want = [int(np.flatnonzero(long == x)[0]) if x in long else -1 for x in short]
        assert alignment.gallop(short, long, begin).tolist() == want


def test_alignment_of_an_empty_table(no_docs):
    assert alignment.align(no_docs, VOCABULARY, PIECES).count() == 0
