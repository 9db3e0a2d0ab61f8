"""Language identification by rank-order profiles of letter n-grams.

A profile is a language's most frequent n-grams in order. A document's own most
frequent n-grams are compared with each profile: every n-gram costs the number
of places by which it is out of place, or the length of a profile if it is not
in it, and the language of the least cost wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexwright.llm.columnar import small_batches

#: N-grams of 1 to 3 letters; a word's ends count as a letter.
LONGEST = 3
PROFILE = 300
UNKNOWN = "und"
_SALTS = 16
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text as 63-bit numbers in order, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    # Anything between words becomes one mark, and one stands before and after all.
    marked = np.where(letter, codes, 0x20).astype(np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    line = np.concatenate(([0x20], marked[kept], [0x20]))
    inside = line != 0x20
    pairs = line[:-1] | line[1:] << 21
    found = [line[inside], pairs[inside[:-1] | inside[1:]], (pairs[:-1] | line[2:] << 42)[inside[1:-1]]]
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; equals by their number."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, np.concatenate([c for _, c in parts]))
    return keys, sums


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = PROFILE) -> dict[str, list[int]]:
    """Each language's profile, from all rows with a language and a text.

    Tasks combine counts by language before they are sent; the best are found
    within salted shares of a language first. What reaches the driver is ``most``
    numbers for each language.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("body")).dropna()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(name, [])
                parts.append(grams(body))
                if len(parts) > 200:
                    held[name] = [_merged(parts)]
        for name, parts in held.items():
            keys, sums = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(sums)], ["lang", "gram", "n"])

    counts = slim.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    shares = counts.withColumn("share", F.pmod(F.hash("gram"), F.lit(_SALTS)))
    near = shares.withColumn("r", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("r") <= most)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= most)
    profiles: dict[str, list[int]] = {}
    for row in sorted(best.select("lang", "gram", "r").collect(), key=lambda x: (x["lang"], x["r"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """All profiles as one sorted list of n-grams and a table of places by language."""

    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most = sorted(profiles), most
        self.grams = np.unique(np.array([g for n in self.names for g in profiles[n]], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language of least cost, equals by code point; 1 for no cost, 0 for the most possible."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.most)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        places = self.places[np.where(self.grams[at] == own, at, len(self.grams))]
        cost = np.where(places < 0, self.most, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(cost))
        return self.names[best], 1.0 - float(cost[best]) / (self.most * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if no language was learned. All columns stay, those of the two names are
    replaced; repeated rows get the same answer, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    framed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            found = [model.judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["row", "lang_pred", "score"])

    schema = framed.select("row", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return framed.mapInArrow(judged, schema).select("row.*", "lang_pred", "score")
