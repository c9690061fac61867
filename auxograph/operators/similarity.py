"""The most similar candidate of each word, by the Ratcliff-Obershelp ratio, as a join.

The ratio is twice the matched characters over the characters of both words, and no more characters can
match than both have in common, each as often as it comes. So a ratio of at least c needs

* lengths within a factor of (2 - c) / c of each other, and
* an overlap of the multisets of characters of at least c / 2 times the sum of the lengths.

The second is a set overlap if characters are numbered by occurrence (``a1``, ``a2``, ...), and then an
inverted index finds all pairs: with the same rare-first order on both sides, two words with that
overlap share one of the first ``n - n * c / (2 - c) + 1`` entries of each. Pairs that meet there are
kept at their first common entry only, if what is left of both words can still reach the overlap, and if
they do reach it; what survives is compared.

Only the best candidate counts, so words take part in rounds, the strictest first: equal words, then a
few bounds down to the cutoff. A round of bound c finds every candidate of at least c, so a word that has one is
done; later rounds, whose indexes are longer, only see words without a good match.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxograph.functions.stored import stored

#: Bounds of the rounds before the last one.
ROUNDS = (0.9, 0.8, 0.7)
#: Entries whose frequency orders them; the others count as rarest.
MOST_ENTRIES = 10_000
#: Words of so many characters have their frequent characters left out of the ratio, so equal ones may be less alike than 1.
_LONG = 200
_NEARLY = 1e-9


def _entries(word: str) -> list[str]:
    """The characters with their number of occurrence."""
    seen: Counter = Counter()
    out = []
    for c in word:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def _indexed(frequency: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            entries = [sorted(_entries(w), key=lambda e: (frequency.get(e, 0), e)) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array([len(e) for e in entries], pa.int32()), pa.array(entries, pa.list_(pa.string()))], names=["w", "n", "entries"])

    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for w in batch.column(0).to_pylist():
            found.update(_entries(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])


def _compared(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher, last, scores = difflib.SequenceMatcher(), None, []
            for w, c in zip(batch.column("w").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if w != last:
                    matcher.set_seq2(w)
                    last = w
                matcher.set_seq1(c)
                scores.append(matcher.ratio())
            scored = pa.RecordBatch.from_arrays([batch.column("w"), batch.column("c"), pa.array(scores, pa.float64())], names=["w", "c", "score"])
            yield scored.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return rows


def _prefixes(words: DataFrame, least: float, name: str) -> DataFrame:
    """A row for each of a word's first entries, by which it is found from an overlap for the bound ``least``."""
    size = F.col("n") - F.ceil(F.col("n") * (least / (2 - least)) - _NEARLY) + 1
    first = F.slice("entries", 1, F.greatest(F.lit(0), size).cast("int"))
    rows = words.withColumn("first", first).select("w", "n", "entries", "first", F.posexplode("first").alias("at", "entry"))
    return rows.select("entry", *[F.col(c).alias(f"{name}_{c}") for c in ("w", "n", "entries", "first", "at")])


def _alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(w, c, score) of all pairs with a score of at least ``least``; both sides: (w, n, entries)."""
    met = _prefixes(left, least, "l").join(_prefixes(right, least, "r"), "entry")
    n, m = F.col("l_n"), F.col("r_n")
    needed: Column = (n + m) * (least / 2) - _NEARLY
    rest = 1 + F.least(n - F.col("l_at"), m - F.col("r_at")) - 1
    near = met.where((m >= n * (least / (2 - least)) - _NEARLY) & (n >= m * (least / (2 - least)) - _NEARLY) & (rest >= needed))
    near = near.where(F.element_at(F.array_intersect("l_first", "r_first"), 1) == F.col("entry"))
    near = near.where(F.size(F.array_intersect("l_entries", "r_entries")) >= needed)
    return near.select(F.col("l_w").alias("w"), F.col("r_w").alias("c")).mapInArrow(_compared(least), "w string, c string, score double")


def most_similar(left: DataFrame, word: str, right: DataFrame, candidate: str, cutoff: float = 0.6) -> DataFrame:
    """Add ``match``, the candidate with the highest ratio to ``word`` of at least ``cutoff``, and its ``score``.

    Of equal scores the lexicographically largest candidate counts. A null word has no match; null candidates
    are none. Neither side is collected or sent anywhere as a whole; repeated words are searched once.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0 and at most 1")
    spark = left.sparkSession
    words = left.select(F.col(word).alias("w")).where("w is not null").distinct()
    candidates = right.select(F.col(candidate).alias("w")).where("w is not null").distinct()
    counts = candidates.mapInArrow(_counted, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    frequency = {r["entry"]: r["n"] for r in counts.orderBy(F.desc("n"), "entry").limit(MOST_ENTRIES).collect()}
    known = "w string, n int, entries array<string>"
    index = stored(candidates.mapInArrow(_indexed(frequency), known), "candidates")
    open_ = stored(words.mapInArrow(_indexed(frequency), known), "words")
    equal = open_.where(F.col("n") < _LONG).join(index.select("w"), "w", "left_semi")
    found = [equal.select("w", F.col("w").alias("c"), F.lit(1.0).alias("score"))]
    open_ = open_.join(equal.select("w"), "w", "left_anti")
    for i, least in enumerate([*(r for r in ROUNDS if r > cutoff), cutoff]):
        best = F.max(F.struct("score", "c")).alias("best")
        alike = stored(_alike(open_, index, least).groupBy("w").agg(best).select("w", "best.c", "best.score"), f"alike-{i}")
        found.append(alike)
        open_ = stored(open_.join(alike.select("w"), "w", "left_anti"), f"open-{i}")
        if not open_.head(1):
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.select(F.col("w").alias("_word"), F.col("c").alias("match"), "score")
    return left.join(every, left[word] == every["_word"], "left").drop("_word")
