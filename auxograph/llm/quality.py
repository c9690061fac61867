"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer.

1. Labellers. Each looks at one property of a text (shouting, symbols, repeated words, recurring
   runs of words, list marks, function words, sentence marks, word variety) and votes junk, clean or
   abstains. They overlap and none is right always.
2. Weak-label model. All documents are counted by their pattern of votes: at most 3 ** labellers
   counts, however many documents there are. Expectation-maximisation on the counts estimates the
   share of junk and, for each labeller, how often it casts each vote on junk and on clean texts; no
   true label is used. A pattern's posterior is the weak label of its documents.
3. Scorer. Texts become counts of hashed features: shapes of words (case, digits, marks, length),
   pairs of shapes, and levels of the measured properties. A logistic regression on a bounded sample
   learns the posteriors, and scores every whole text.

The scorer generalises over the patterns: it sees more of a text than the votes, and texts on which
all labellers abstain get a score of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.llm.shared import Scratch
from auxograph.llm.words import Words, chunks, mixed, windows

#: Property: (limit, vote) pairs; a value at or over the first limit is junk, under the second clean.
#: ``variety``, ``function`` and ``marks`` are junk when low, so they are measured as 1 - value.
LABELLERS = {
    "shouting": (0.35, 0.12),
    "capitals": (0.30, 0.08),
    "symbols": (0.06, 0.02),
    "symbol_words": (0.25, 0.05),
    "stutter": (0.25, 0.05),
    "recurring": (0.45, 0.15),
    "listing": (0.25, 0.03),
    "no_function_words": (0.95, 0.85),
    "sameness": (0.80, 0.55),
    "odd_sentences": (0.90, 0.50),
}
#: A labeller with less than so many words to look at abstains.
LEAST_WORDS = {"shouting": 4, "capitals": 4, "symbols": 4, "symbol_words": 4, "stutter": 6, "recurring": 30, "no_function_words": 40, "sameness": 60, "odd_sentences": 40, "listing": 8}
#: Frequent short words of the languages that are expected.
FUNCTION_WORDS = (
    "the of and to in a is it that for with as was on be by this from are or an at not he "
    "le la les de des du et un une en que qui dans pour par est au sur pas avec il "
    "der die das und in den von zu mit sich auf ist im dem nicht ein eine als auch es für "
    "el los las del y se por con para su al lo como"
).split()
FEATURES = 1 << 14
#: Bounds of the training sample, in documents and in features (8 bytes each), and features that a step works on at once.
TRAIN_DOCS = 20_000
TRAIN_FEATURES = 5_000_000
TOGETHER = 250_000
STEPS = 300
#: Documents whose score, the probability of being clean, is lower are rejected.
LEAST_SCORE = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;,"]] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


class Measured:
    """The properties of consecutive texts, and what features are made of."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = self.words = Words(data, offsets, "not_blank")
        self.n = words.counts
        of = words.text_of_word()
        texts = len(self.n)
        per_text = lambda x: np.bincount(of, x, texts)
        hashes = words.hashes(lower=True)
        size = words.ends - words.starts
        upper, lower, digit, symbol, high = (_sums(t[data], words.starts, words.ends) for t in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _HIGH))
        last = data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
        first = data[words.starts] if len(words) else np.zeros(0, np.uint8)
        follows = np.zeros(len(words), bool)
        follows[1:] = of[1:] == of[:-1]
        same = np.zeros(len(words), bool)
        same[1:] = follows[1:] & (hashes[1:] == hashes[:-1])
        letters = per_text(upper + lower)
        bytes_in = per_text(size)
        # runs of 6 words that have come before in the text
        runs = windows(hashes, 6)
        run_of = of[: len(runs)][of[5:] == of[: len(runs)]] if len(runs) else of[:0]
        runs = runs[of[5:] == of[: len(runs)]] if len(runs) else runs
        salted = mixed(runs + run_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, kept = np.unique(salted, return_index=True)
        distinct_runs, all_runs = np.bincount(run_of[kept], minlength=texts), np.bincount(run_of, minlength=texts)
        salted = mixed(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, kept = np.unique(salted, return_index=True)
        distinct = np.bincount(of[kept], minlength=texts)
        bare = (upper + lower + digit + high) == 0
        function = np.isin(hashes, _function_hashes())
        ending = _END[last]
        sentence = _ratio(per_text(ending), self.n)
        self.values = {
            "shouting": _ratio(per_text(upper), letters),
            "capitals": _ratio(per_text((upper > 1) & (lower == 0)), self.n),
            "symbols": _ratio(per_text(symbol), bytes_in),
            "symbol_words": _ratio(per_text((symbol > 0) & (size > symbol)), self.n),
            "stutter": _ratio(per_text(same), self.n),
            "recurring": 1 - _ratio(distinct_runs, all_runs) * (all_runs > 0) - (all_runs == 0),
            "listing": _ratio(per_text(bare), self.n),
            "no_function_words": 1 - _ratio(per_text(function), self.n),
            # long texts repeat words by nature: the root of the number of words is expected to differ
            "sameness": 1 - np.minimum(1, _ratio(distinct, np.minimum(self.n, 40 + 2 * np.sqrt(self.n)))),
            "odd_sentences": np.clip(np.where(sentence > 0.5, 2 * (sentence - 0.25), 1 - 12 * sentence), 0, 1),
        }
        kind = lambda b: np.select([_UPPER[b], _LOWER[b], _DIGIT[b], _HIGH[b]], [1, 2, 3, 4], b.astype(np.int64) + 8)
        level = np.minimum(size, 15).astype(np.int64) // 2
        case = np.select([(upper > 1) & (lower == 0), upper > 1, upper == 1], [3, 2, 1], 0)
        shape = ((kind(first) * 512 + kind(last)) * 8 + level) * 4 + case
        shape = shape * 8 + np.minimum(symbol, 3) * 2 + (digit > 0)
        shape = shape * 2 + same
        previous = np.zeros(len(words), np.int64)
        previous[1:] = np.where(follows[1:], shape[:-1] + 1, 0)
        self.of = of
        # sizes are left out of pairs, or there would be too many of them
        coarse = lambda s: s // 256 // 32 * 256 + s % 256
        pair = coarse(previous) * 0x1000003 + coarse(shape)
        self.shapes = [mixed(shape.astype(np.uint64)), mixed(pair.astype(np.uint64) + np.uint64(1 << 60))]

    def votes(self) -> np.ndarray:
        """For each text the pattern of votes: base 3, the first labeller lowest; 0 abstains, 1 clean, 2 junk."""
        pattern = np.zeros(len(self.n), np.int64)
        for i, (name, (junk, clean)) in enumerate(LABELLERS.items()):
            value = self.values[name]
            vote = np.select([value >= junk, value < clean], [2, 1], 0)
            vote[self.n < LEAST_WORDS.get(name, 1)] = 0
            pattern += vote * 3**i
        return pattern

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, weight) triples; the weights of shapes are shares of a text's words."""
        texts = len(self.n)
        of = [self.of, self.of]
        entry = [(h & np.uint64(FEATURES - 1)).astype(np.int64) for h in self.shapes]
        weight = [1 / np.maximum(self.n[self.of], 1)] * 2
        for i, (name, value) in enumerate(self.values.items()):
            level = np.minimum(value * 10, 9).astype(np.uint64) + np.uint64(16 * i)
            level = np.where(self.n < LEAST_WORDS.get(name, 1), np.uint64(16 * i + 15), level)
            of.append(np.arange(texts))
            entry.append((mixed(level + np.uint64(1 << 61)) & np.uint64(FEATURES - 1)).astype(np.int64))
            weight.append(np.full(texts, 0.5))
        return np.concatenate(of), np.concatenate(entry), np.concatenate(weight)


_cached: dict[str, np.ndarray] = {}


def _function_hashes() -> np.ndarray:
    if "function" not in _cached:
        words = pa.array([w + end for w in FUNCTION_WORDS for end in ("", ",", ".")])
        _cached["function"] = np.concatenate([Words(d, o, "not_blank").hashes(lower=True) for _, _, d, o in chunks(words)])
    return _cached["function"]


def weak_labels(counts: dict[int, int], steps: int = 100) -> tuple[dict[int, float], dict[str, dict[str, float]]]:
    """EM over the counts of vote patterns: the probability of junk by pattern, and the labellers' accuracies.

    A labeller is a test that is passed (clean) or failed (junk) or not made (abstains), with a rate of
    failure in each class; tests are taken to be independent given the class. The start calls junk
    what fails any test, for a test that looks at one kind of junk says nothing about other kinds. A
    thousandth of the documents is added to each count, which keeps the rates off 0 and 1.
    """
    if not counts:
        return {}, {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns], np.float64)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    junk = np.where((votes == 2).any(1), 0.95, 0.02)
    for _ in range(steps):
        fails = np.zeros((2, len(LABELLERS)))
        for c, p in enumerate((1 - junk, junk)):
            weight = (n * p)[:, None]
            fails[c] = ((weight * (votes == 2)).sum(0) + n.sum() / 1000) / ((weight * (votes > 0)).sum(0) + n.sum() / 500)
        share = ((n * junk).sum() + 1) / (n.sum() + 2)
        said = np.select([votes == 2, votes == 1], [np.log(fails[1] / fails[0]), np.log((1 - fails[1]) / (1 - fails[0]))], 0.0)
        junk = 1 / (1 + np.exp(-np.clip(said.sum(1) + np.log(share / (1 - share)), -30, 30)))
    accuracy = {
        name: {"junk_votes_on_junk": float(fails[1, i]), "clean_votes_on_clean": float(1 - fails[0, i])}
        for i, name in enumerate(LABELLERS)
    }
    return dict(zip(patterns.tolist(), junk.tolist())), accuracy


def fit(of: np.ndarray, entry: np.ndarray, weight: np.ndarray, junk: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on hashed features: weights and bias towards clean."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not len(junk):
        return weights, 2.0
    clean = 1 - junk
    # documents in runs of about TOGETHER features, so that what a step holds beside the sample stays small
    edges = np.searchsorted(of, np.arange(len(junk) + 1))
    runs, first = [], 0
    while first < len(junk):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + TOGETHER, side="right")) - 1)
        runs.append((first, last, int(edges[first]), int(edges[last])))
        first = last
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, steps + 1):
        gradient = np.append(1e-6 * weights, 0.0)
        for first, last, x, y in runs:
            doc, e, w = of[x:y] - first, entry[x:y], weight[x:y]
            logit = np.bincount(doc, weights[e] * w, last - first) + bias
            off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - clean[first:last]) / len(junk)
            gradient[:-1] += np.bincount(e, off[doc] * w, FEATURES)
            gradient[-1] += off.sum()
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            found, n = np.unique(Measured(data, offsets).votes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            seen = Measured(data, offsets)
            of, entry, weight = seen.features()
            key, inverse = np.unique(of * FEATURES + entry, return_inverse=True)
            total = np.bincount(inverse, weight, len(key))
            at = np.searchsorted(key // FEATURES, np.arange(len(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("h").slice(a, b - a),
                    pa.array(seen.votes()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array((key % FEATURES).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(total.astype(np.float32))),
                ],
                names=["h", "pattern", "entries", "weights"],
            )


class Scorer:
    """The trained scorer: FEATURES numbers and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vote pattern and probability of being clean of each text."""
        seen = Measured(data, offsets)
        of, entry, weight = seen.features()
        logit = np.bincount(of, self.weights[entry] * weight, len(offsets) - 1) + self.bias
        return seen.votes(), 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_features: int = TRAIN_FEATURES):
    """The scorer, the patterns' weak labels and the labellers' accuracies.

    Vote patterns are counted over all documents. ``train_docs`` bounds the documents the scorer is
    fitted on; they are chosen by a hash of the identifier, and at most twice as many are fetched, with
    ``train_features`` features at most (one document at least).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    junk, accuracy = weak_labels({r["pattern"]: r["n"] for r in counts})
    total = sum(r["n"] for r in counts)
    million = 1_000_000
    share = int(million * train_docs / max(total, 1)) + 1
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(million)) < share)
    # about train_docs rows are left; where a chosen identifier has many, the first by a hash of the text count
    chosen = chosen.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("order")).alias("h"))
    sample = chosen.mapInArrow(_featured, "h long, pattern long, entries array<int>, weights array<float>")
    sample = scratch.keep(sample, "sample")
    sizes = sample.select("h", F.size("entries").cast("long").alias("n")).orderBy("h").limit(2 * train_docs).toArrow().column("n").to_numpy()
    # the first documents in the order of their hashes whose features are within the bound
    n = max(1, int(np.searchsorted(np.cumsum(sizes), train_features, side="right")))
    sample = sample.orderBy("h").limit(n).toArrow().combine_chunks()
    scratch.drop("sample")
    if not sample.num_rows:
        return Scorer(*fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))), junk, accuracy
    lists = sample.column("entries").combine_chunks()
    of = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
    entry = lists.flatten().to_numpy()
    weight = sample.column("weights").combine_chunks().flatten().to_numpy()
    label = np.array([junk[p] for p in sample.column("pattern").to_pylist()])
    scorer = Scorer(*fit(of, entry, weight, label))
    # the driver goes on for long after this: let it have the sample's memory
    del sample, lists, of, entry, weight
    pa.default_memory_pool().release_unused()
    return scorer, junk, accuracy


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_docs: int = TRAIN_DOCS,
    least_score: float = LEAST_SCORE,
) -> DataFrame:
    """All rows and columns of ``docs`` with weak_junk, score and kept.

    ``weak_junk`` is the weak label (posterior of junk), ``score`` the scorer's probability that the
    text is clean, ``kept`` whether it is at least ``least_score``.

    * A null, empty or blank text shows no sign of junk: the labellers abstain or vote clean, and it
      is scored like any text. Repeated rows get equal scores.
    * Only identifier and text are looked at. A null identifier is scored like any other.
    * An empty table gives an empty result.
    * Columns of ``docs`` named like the new ones are replaced by them.
    """
    scorer, junk, _ = train(docs, id_col, text_col, train_docs)
    new = ("weak_junk", "score", "kept")
    passed = docs.drop(*new)
    names = passed.columns
    place = names.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(place)):
                pattern, score = scorer(data, offsets)
                some = batch.slice(a, b - a)
                weak = pa.array([junk.get(p, 0.5) for p in pattern.tolist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns, weak, pa.array(score), pa.array(score >= least_score)], names=[*names, *new])

    added = [T.StructField("weak_junk", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*passed.schema.fields, *added])
    return passed.mapInArrow(scored, schema)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns, whatever their names."""
    # the row travels in one struct, so that its names meet no others
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return quality(rows, **options).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the quality of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs.select("doc_id", "text")).select("doc_id", "weak_junk", "score", "kept")
