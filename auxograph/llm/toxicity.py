"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (bytes of the lower-cased word between
boundary marks, hashed to a table), a span of ``SPAN`` words is the mean of its words (a word that it
repeats, or that it is too short to have, adds nothing), and a linear softmax turns that into two
classes. Table and softmax are trained together. A misspelling of a word that
training saw shares most of its n-grams, and so most of its vector.

A document may be toxic in one sentence only. So it is cut into spans, and it is as
toxic as its most toxic span; training learns from that span of each document (after a start from
the mean of all of them). The softmax of a mean of means is linear in the n-grams, so a trained model
comes down to one number per table entry, 256 KB in all, and that is what scoring tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxograph.llm.shared import importable
from auxograph.llm.words import Words, byte_values, chunks, mixed

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
SPAN = 32
#: Bounds of the training sample, for each class: documents, and bytes of their texts together.
TRAIN_PER_CLASS = 2_500
TRAIN_BYTES = 8 << 20
#: Bytes of the sample that are cut into n-grams together, and words that are worked on together.
TRAIN_CHUNK = 1 << 17
TRAIN_WORDS = 20_000
EPOCHS = 60
WARM_EPOCHS = 5
THRESHOLD = 0.3
#: Step sizes of table, softmax and bias.
RATES = (0.3, 0.05, 0.05)
#: Occurrences that are added to every n-gram's when its step is scaled.
SMOOTHING = 20.0
#: Weight of a text without words, labelled 0, as a share of the sample.
EMPTY_SHARE = 0.5


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of all n-grams, word by word, and their number for each word."""
    lengths = words.ends - words.starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    stream = np.zeros(at[-1], np.int64)
    inner = np.arange(at[-1] - 2 * len(words)) if len(words) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(words)), lengths - 2)
    first = at[:-1] - 2 * np.arange(len(words))
    stream[at[word] + 1 + inner - first[word]] = words.data[words.starts[word] + inner - first[word]]
    stream[at[:-1]], stream[at[1:] - 1] = 0x3C, 0x3E
    left = np.repeat(at[1:], lengths) - np.arange(at[-1])
    value = byte_values(7, True)[stream]
    entries, owners = [], []
    total = np.zeros(at[-1], np.uint64)
    place = np.arange(at[-1])
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(at[-1], np.uint64)
        shifted[: at[-1] - n + 1] = value[n - 1 :]
        total = total * np.uint64(0x9E3779B97F4A7C15) + shifted
        if n in GRAMS:
            good = left >= n
            entries.append((mixed(total[good]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(place[good])
    # words shorter than the least n-gram are an entry of their own
    short = np.flatnonzero(lengths < min(GRAMS))
    entries.append((mixed(words.hashes(7)[short]) & np.uint64(BUCKETS - 1)).astype(np.int32))
    owners.append(at[short])
    entry, owner = np.concatenate(entries), np.concatenate(owners)
    counts = sum(np.maximum(0, lengths - n + 1) for n in GRAMS) if len(words) else np.zeros(0, np.int64)
    counts = np.where(lengths < min(GRAMS), 1, counts)
    return entry[np.argsort(owner, kind="stable")], counts


def _spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that count, where each span begins among them, and the text each span is of.

    A last short span joins the one before. A word that a span repeats counts once in it.
    """
    counts = words.counts
    n = np.maximum(counts // SPAN, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(counts)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    starts = words.of[of] + inner * SPAN
    span = np.repeat(np.arange(len(of)), np.diff(np.append(starts, len(words))))
    _, first = np.unique(mixed(words.hashes(7, lower=True) + span.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return first, np.searchsorted(span[first], np.arange(len(of))), of


@dataclass
class Model:
    """``scores``: for each table entry, its vector times the difference of the softmax's rows."""

    scores: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        words = Words(data, offsets, "alnum")
        if not len(words):
            return out
        entry, counts = _grams(words)
        per_word = np.add.reduceat(self.scores[entry], np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts
        kept, begin, of = _spans(words)
        spans = np.add.reduceat(per_word[kept], begin) / SPAN + self.bias
        most = np.full(len(out), -np.inf)
        np.maximum.at(most, of, spans)
        return np.where(np.isfinite(most), most, out)


def train(sample: list[tuple[str, int]], prior: float, seed: int = 5) -> Model:
    """Fit table and softmax to (text, class) pairs; ``prior``: the share of class 1 in the corpus."""
    column = pc.utf8_lower(pa.array([t for t, _ in sample], pa.string()))
    label = np.array([y for _, y in sample], np.float64)
    share = label.mean() if len(label) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if share == 1 else -20.0)
    vocabulary: dict[int, int] = {}
    entries, per_word, members, span_lengths, span_of = [], [], [], [], []
    for a, _, data, offsets in chunks(column, TRAIN_CHUNK):
        words = Words(data, offsets, "alnum")
        if not len(words):
            continue
        entry, counts = _grams(words)
        first_entry = np.cumsum(counts) - counts
        distinct, first, inverse = np.unique(words.hashes(7, lower=True), return_index=True, return_inverse=True)
        number = np.empty(len(distinct), np.int32)
        new = []
        for i, (h, f) in enumerate(zip(distinct.tolist(), first.tolist())):
            if h not in vocabulary:
                vocabulary[h] = len(vocabulary)
                new.append(f)
            number[i] = vocabulary[h]
        if new:
            # copies of the new words' entries, so that the chunk's can go
            n = counts[new]
            entries.append(entry[np.repeat(first_entry[new] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            per_word.append(n)
        kept, begin, of = _spans(words)
        members.append(number[inverse[kept]])
        span_lengths.append(np.diff(np.append(begin, len(kept))))
        span_of.append(of + a)
    if not members:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    entry, per_word = np.concatenate(entries), np.concatenate(per_word)
    member, length, of = np.concatenate(members), np.concatenate(span_lengths), np.concatenate(span_of)
    word_begin = np.concatenate([[0], np.cumsum(per_word)[:-1]])
    span_begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    doc_begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    docs = of[doc_begin]
    doc_spans = np.diff(np.append(doc_begin, len(of)))
    y = label[docs]
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.array([0.0, 0.0])
    parameters = [table, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros(())) for p in parameters]
    # gradients grow with an n-gram's frequency, their noise with its root: dividing by the root lets
    # n-grams that recur in one class move most, and not those of every document or of a single one
    # words are taken some at a time, so that nothing as long as all their n-grams is made
    parts = [slice(a, a + TRAIN_WORDS) for a in range(0, len(per_word), TRAIN_WORDS)]
    grams = [entry[word_begin[w][0] : word_begin[w][-1] + per_word[w][-1]] for w in parts]

    def to_entries(of_words: np.ndarray) -> np.ndarray:
        return sum(np.bincount(g, np.repeat(of_words[w], per_word[w]), BUCKETS) for w, g in zip(parts, grams))

    def to_words(of_entries: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(of_entries[g], word_begin[w] - word_begin[w][0]) for w, g in zip(parts, grams)])

    frequency = to_entries(np.bincount(member, minlength=len(per_word)) / per_word)
    scale = (1 / np.sqrt(frequency + SMOOTHING))[:, None]
    for epoch in range(EPOCHS):
        direction = softmax[:, 1] - softmax[:, 0]
        word = to_words(table @ direction) / per_word
        span = np.add.reduceat(word.astype(np.float32)[member], span_begin) / np.float32(SPAN)
        if epoch < WARM_EPOCHS:
            weight = np.repeat(1 / doc_spans, doc_spans)
        else:
            top = np.repeat(np.maximum.reduceat(span, doc_begin), doc_spans)
            weight = (span == top).astype(np.float64)
            weight /= np.repeat(np.add.reduceat(weight, doc_begin), doc_spans)
        logit = np.add.reduceat(weight * span, doc_begin) + bias[1] - bias[0]
        off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        # a span without words is clean: the bias alone must not come near to a verdict
        nothing = EMPTY_SHARE / (1 + np.exp(bias[0] - bias[1]))
        span_off = np.repeat(off, doc_spans) * weight / SPAN
        # after the start only the most toxic spans have a weight, and only their words are looked at
        if epoch < WARM_EPOCHS:
            word_off = np.bincount(member, np.repeat(span_off, length), len(per_word)) / per_word
        else:
            some = np.flatnonzero(weight)
            words_of = np.repeat(span_begin[some] - np.cumsum(length[some]) + length[some], length[some]) + np.arange(length[some].sum())
            word_off = np.bincount(member[words_of], np.repeat(span_off[some], length[some]), len(per_word)) / per_word
        entry_off = to_entries(word_off)
        toward = entry_off @ table
        gradients = [scale * np.outer(entry_off, direction), np.stack([-toward, toward], 1), np.array([-1.0, 1.0]) * (off.sum() + nothing)]
        for p, g, (m, v), rate in zip(parameters, gradients, moments, RATES):
            m += 0.1 * (g - m)
            v += 0.01 * ((g * g).mean() - v)
            t = epoch + 1
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))


def training_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES
) -> tuple[list[tuple[str, int]], float]:
    """Labelled documents of each class, whole, and the share of class 1 among all labels.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic. A class gives the first documents in the order
    of a hash of identifier and text: at most ``per_class``, and as many as have ``most_bytes`` of
    text together (one at least), however long each is. That bounds what the driver holds. A document
    with several labels counts with the largest; a document that comes several times counts once.
    """
    classes = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in classes.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return [], 0.0
    # by a hash of the identifier somewhat more of each class than is asked for, whatever the number of labels
    million, wanted = 1_000_000, F.lit(False)
    for c, n in sizes.items():
        wanted |= (F.col("toxic") == c) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(million)) < int(1.2 * million * per_class / n) + 1)
    some = classes.where(wanted)
    if some.limit(4 * per_class + 1).count() <= 4 * per_class:
        some = F.broadcast(some)
    order = F.xxhash64("doc_id", "text", F.lit("order"))
    found = docs.join(some, "doc_id").where(F.col("text").isNotNull())
    slim = found.select("toxic", order.alias("h"), F.octet_length("text").alias("bytes")).distinct()
    first = [slim.where(F.col("toxic") == c).orderBy("h").limit(per_class) for c in sorted(sizes)]
    chosen: list[tuple[int, int]] = []
    for c in sorted(sizes):
        used = 0
        for r in first[sorted(sizes).index(c)].collect():
            used += r["bytes"]
            if used > most_bytes and chosen and chosen[-1][1] == c:
                break
            chosen.append((r["h"], c))
    hashes = docs.sparkSession.createDataFrame([(h,) for h, _ in chosen], "h long")
    texts = found.withColumn("h", order).join(F.broadcast(hashes), "h").dropDuplicates(["h"]).select("h", "toxic", "text")
    rows = sorted((r["toxic"], r["h"], r["text"]) for r in texts.toLocalIterator())
    return [(t, c) for c, _, t in rows], min(max(sizes.get(1, 0) / total, 1e-6), 1 - 1e-6)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row: the model's probability of class 1 over the whole text."""
    importable(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for a, b, data, offsets in chunks(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))):
                p = 1 / (1 + np.exp(-np.clip(model.logits(data, offsets), -30, 30)))
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(p)], names=["doc_id", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(scored, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of its identifier, as text, modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The model learns from the labels of rows that are not held out, and from no other column.

    * A null, empty or blank text, and one without letters and digits, has the score of no evidence.
    * Repeated rows get equal scores. A null identifier has no label and is not held out.
    * Without labels, or with labels of one class only, every score is that of the only class (0 if
      there is none). An empty table gives an empty result.
    * Labels other than 0 and 1 are ignored. Columns of the same name in both tables do not meet.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic")).where(~held_out())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(*training_sample(texts, known))
    found = score(docs, model, id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the toxicity of ``documents``."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
