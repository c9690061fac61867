"""Substring deduplication by fixed-block anchors.

A window of ``WINDOW`` = 13 words holds a whole aligned block of ``BLOCK`` = 7 words wherever it
begins (13 = 2 * 7 - 1). So if a window occurs in two documents, one of the aligned blocks of either
document occurs in the other one, at any position.

1. Anchors. Each document's non-overlapping blocks are the index, and every rolling run of 7 words is
   a probe. Both go to buckets by hash, packed many to a row; a task gathers texts until its packs are
   of some thousand runs each. A bucket is read as a stream, blocks first: of each block it keeps the smallest and the largest document that has it, so its memory
   is bounded by its distinct blocks, however many documents share one. A run that is a block of
   another document is a mark of its document, and so is the block that was hit.
2. Extension. Around its marks each document is extended to all windows that hold a marked run: the
   candidates. They are confirmed by the hashes of all their 13 words. Buckets of candidates are
   streams in ascending order of document, so the first document with a window is the smallest that
   has it, and any later one has a repeat.
3. Repeats that overlap or touch run together to maximal repeats, whose words are removed.

Marks and repeats meet the texts in streams sorted by document, so no task holds more than a batch. The
rows of an identifier that many rows share (or of null) are cut into parts, each of which meets all of
its marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxograph.llm.shared import Scratch, importable, spread
from auxograph.llm.words import Words, chunks, mixed, windows

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Runs of words that one bucket is meant to hold.
BUCKET_RUNS = 4_000_000
#: Bytes of text that are worked on together.
PACK_BYTES = 1 << 20
#: Entries of a bucket that are worked on together.
TOGETHER = 500_000
#: Runs that a pack is meant to hold, and runs that a task gathers for its packs at most (some 100 MB).
PACK_RUNS = 2_000
MOST_RUNS = 2_000_000
#: Stands for a null identifier: after all others, which are moved down by one if one of them is as large.
NULL_KEY = 2**63 - 1
#: Bytes of text that one part of an identifier's rows holds.
PART_BYTES = 128 << 20

PACKED = "bucket int, kind int, first_doc long, hashes binary, docs binary"
_packed = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("first_doc", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
_marked = pa.schema([("doc", pa.int64()), ("key", pa.int64())])


def _squeezed(docs: np.ndarray) -> bytes:
    """Documents as differences, byte plane by byte plane, compressed: about a byte each where they come in order."""
    return pa.compress(np.diff(docs, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(-1))


def _inside(of: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of ``n`` runs of ``k`` words lie in one text."""
    return of[:n] == of[k - 1 : k - 1 + n]


def _packs(bucket: np.ndarray, hashes: np.ndarray, docs: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row per bucket; the entries keep their order in it."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, hashes, docs = bucket[order], hashes[order], docs[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(bucket)) if len(bucket) else edges
    at = (np.append(edges, len(bucket)) * hashes.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[edges], pa.int32()),
            pa.array(np.full(len(edges), kind, np.int32)),
            pa.array(docs[edges]),
            pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(at), pa.py_buffer(hashes)]),
            pa.array([_squeezed(docs[a:b]) for a, b in zip(edges, ends)], pa.binary()),
        ],
        schema=_packed,
    )


class _Packer:
    """Gathers entries until there are enough for good packs."""

    def __init__(self, buckets: int, kind: int):
        self.kind, self.enough = kind, min(MOST_RUNS, buckets * PACK_RUNS)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, bucket: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append((bucket.astype(np.int32), hashes, docs))
        self.n += len(docs)
        if self.n >= self.enough:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _packs(*(np.concatenate(x) for x in zip(*self.waiting)), self.kind)
        self.waiting, self.n = [], 0


def _run_key(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a run's hash, and the 32 bits that tell it from others of the bucket.

    Two runs that agree by chance in both make a needless mark, never a wrong repeat.
    """
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _anchors(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [_Packer(buckets, kind) for kind in (0, 1)]
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for a, b, data, offsets in chunks(batch.column("text"), PACK_BYTES):
                words = Words(data, offsets, "not_blank")
                runs = windows(words.hashes(), BLOCK)
                of = words.text_of_word()
                inside = _inside(of, len(runs), BLOCK)
                owner = of[: len(runs)]
                aligned = inside & ((np.arange(len(runs)) - words.of[owner]) % BLOCK == 0)
                bucket, low = _run_key(runs, buckets)
                docs = ids[a:b][owner]
                for packer, chosen in zip(packers, (aligned, inside)):
                    yield from packer.add(bucket[chosen], low[chosen], docs[chosen])
        for packer in packers:
            yield from packer.rest()

    return rows


class _Blocks:
    """The distinct blocks of a bucket, each with the smallest and largest document that has it."""

    def __init__(self):
        self.hashes, self.least, self.most = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.hit: np.ndarray | None = None

    def add(self, hashes: np.ndarray, docs: np.ndarray) -> None:
        self.waiting.append((hashes, docs))
        self.n += len(hashes)
        if self.n >= TOGETHER:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        hashes = np.concatenate([self.hashes, *(h for h, _ in self.waiting)])
        least = np.concatenate([self.least, *(d for _, d in self.waiting)])
        most = np.concatenate([self.most, *(d for _, d in self.waiting)])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.hashes = hashes[first]
        self.least, self.most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
        self.waiting, self.n = [], 0

    def probe(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which runs are a block of another document."""
        if self.hit is None:
            self.settle()
            self.hit = np.zeros(len(self.hashes), bool)
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        other = known & ((self.least[at] != docs) | (self.most[at] != docs))
        self.hit[at[other]] = True
        return other

    def owners(self) -> np.ndarray:
        """Blocks of one document only that another document's run has hit: their own mark is still due."""
        return np.flatnonzero(self.hit & (self.least == self.most)) if self.hit is not None else np.zeros(0, np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks (document, bucket and hash of a run), from a stream sorted by bucket, blocks first."""
    at, blocks = None, _Blocks()

    def due():
        left = blocks.owners()
        key = (np.int64(at) << 32) | blocks.hashes[left].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(blocks.least[left]), pa.array(key)], schema=_marked)

    for batch in batches:
        for bucket, kind, hashes, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "hashes", "docs"))):
            if bucket != at:
                if at is not None:
                    yield due()
                at, blocks = bucket, _Blocks()
            values = np.frombuffer(hashes, np.uint32)
            owners = _unsqueezed(docs, len(values))
            if kind == 0:
                blocks.add(values, owners)
                continue
            other = blocks.probe(values, owners)
            if other.any():
                key = (np.int64(at) << 32) | values[other].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(owners[other]), pa.array(key)], schema=_marked)
    if at is not None:
        yield due()


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Texts of a stream sorted by document, and the (document, key) pairs of their documents, mixed.

    The stream has rows with a key (kind 0) before the rows with a text (kind 1) of each document.
    """
    docs_left, keys_left = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column("doc").to_numpy()
        is_text = batch.column("kind").to_numpy() == 1
        keys = np.concatenate([keys_left, batch.column("key").fill_null(0).to_numpy()[~is_text]])
        owners = np.concatenate([docs_left, docs[~is_text]])
        texts = batch.filter(pa.array(is_text))
        if texts.num_rows:
            yield texts, np.unique(_pair(owners, keys))
        last = owners == docs[-1]
        docs_left, keys_left = owners[last], keys[last]


def _pair(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mixed(mixed(docs.view(np.uint64)) + keys.view(np.uint64))


def _has(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _candidates(buckets: int):
    """Windows that hold a marked run, packed by bucket; documents come in ascending order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, 2)
        for texts, pairs in _with_texts(batches):
            if not len(pairs):
                continue
            ids = texts.column("doc").to_numpy()
            for a, b, data, offsets in chunks(texts.column("text"), PACK_BYTES):
                words = Words(data, offsets, "not_blank")
                hashes, of = words.hashes(), words.text_of_word()
                runs = windows(hashes, BLOCK)
                if len(hashes) < WINDOW:
                    continue
                bucket, low = _run_key(runs, buckets)
                key = (bucket << 32) | low.astype(np.int64)
                marked = _has(pairs, _pair(ids[a:b][of[: len(runs)]], key)) & _inside(of, len(runs), BLOCK)
                total = np.concatenate([[0], np.cumsum(marked)])
                n = len(hashes) - WINDOW + 1
                near = total[np.arange(n) + WINDOW - BLOCK + 1] > total[np.arange(n)]
                chosen = np.flatnonzero(near & _inside(of, n, WINDOW))
                full, second = windows(hashes, WINDOW)[chosen], windows(hashes, WINDOW, seed=2)[chosen]
                owner = ids[a:b][of[chosen]]
                _, first = np.unique(_pair(owner, full.view(np.int64)), return_index=True)
                first.sort()
                yield from packer.add((second[first] % np.uint64(buckets)).astype(np.int64), full[first], owner[first])
        yield from packer.rest()

    return rows


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, window hash) of windows that a smaller document has, from streams in document order."""
    at, seen, owner = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def worked():
        nonlocal seen, owner, waiting
        hashes, docs = (np.concatenate(x) for x in zip(*waiting))
        waiting = []
        order = np.lexsort((docs, hashes))
        hashes, docs = hashes[order], docs[order]
        first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        least = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
        known = _has(seen, hashes)
        if len(seen):
            earlier = owner[np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)]
            least = np.where(known, earlier, least)
        repeated = docs > least
        new = first & ~known
        seen, owner = np.concatenate([seen, hashes[new]]), np.concatenate([owner, docs[new]])
        order = np.argsort(seen, kind="stable")
        seen, owner = seen[order], owner[order]
        return pa.RecordBatch.from_arrays([pa.array(docs[repeated]), pa.array(hashes[repeated].view(np.int64))], schema=_marked)

    for batch in batches:
        for bucket, hashes, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashes", "docs"))):
            if bucket != at:
                if waiting:
                    yield worked()
                at, seen, owner = bucket, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            values = np.frombuffer(hashes, np.uint64)
            waiting.append((values, _unsqueezed(docs, len(values))))
            if sum(len(v) for v, _ in waiting) >= TOGETHER:
                yield worked()
    if waiting:
        yield worked()


OUT = "doc_id long, text_hash long, n_words long, n_removed long, spans array<array<int>>, kept_text string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's maximal repeats, and what is left of it."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string()]
    names = [x.split()[0] for x in OUT.split(", ")]
    for texts, pairs in _with_texts(batches):
        ids = texts.column("doc").to_numpy()
        names_of, marks = (texts.column(c).to_pylist() for c in ("doc_id", "text_hash"))
        for a, b, data, offsets in chunks(texts.column("text"), PACK_BYTES):
            words = Words(data, offsets, "not_blank")
            of = words.text_of_word()
            covered = np.zeros(len(words), bool)
            n = len(words) - WINDOW + 1
            if n > 0 and len(pairs):
                full = windows(words.hashes(), WINDOW)
                repeated = _has(pairs, _pair(ids[a:b][of[:n]], full.view(np.int64))) & _inside(of, n, WINDOW)
                change = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(repeated)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + WINDOW, -1)
                covered = np.cumsum(change[:-1]) > 0
            out = []
            raw = data.tobytes()
            for i in range(b - a):
                lo, hi = int(words.of[i]), int(words.of[i + 1])
                own = covered[lo:hi]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                cut = raw[offsets[i] : offsets[i + 1]].split()
                kept = [w for w, gone in zip(cut, own.tolist()) if not gone] if len(edges) else cut
                out.append((names_of[a + i], marks[a + i], hi - lo, int(own.sum()), edges.reshape(-1, 2).tolist(), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_removed, spans, kept_text.

    A word goes if it is in a window of 13 words that also begins in a document with a smaller
    identifier. ``spans`` are the removed word ranges [start, end), ``kept_text`` the other words,
    joined by one space. Windows are judged on the input.

    * A null, empty or blank text has no words and an empty ``kept_text``; texts of fewer than 13
      words keep them all.
    * A null identifier is after all others. Rows that share an identifier are not smaller than
      each other, so repeated rows keep what they share; each has a row in the result. (Only where the
      least and the largest long and null are all identifiers, rows with the last two count as one.)
    * An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "substring-dedup")
    tasks = spread(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    sizes = scratch.keep(named.groupBy("doc_id").agg(size.alias("size")), "sizes")
    known = sizes.agg(F.sum("size").alias("size"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    down = int(known["most"] == NULL_KEY and known["least"] != -NULL_KEY - 1)
    doc = F.coalesce(F.col("doc_id") - F.lit(down), F.lit(NULL_KEY)).alias("doc")
    read = named.select("doc_id", doc, "text")
    buckets = max(4 * tasks, (known["size"] or 0) // 6 // BUCKET_RUNS)
    # identifiers whose rows hold more text than one part: each has PART_BYTES of text, so there are few
    parts = F.ceil(F.col("size") / PART_BYTES).cast("int")
    large = F.broadcast(sizes.where(F.col("size") > PART_BYTES).select(doc, parts.alias("parts")))
    parts = F.coalesce("parts", F.lit(1))

    packed = read.select("doc", "text").mapInArrow(_anchors(buckets), PACKED)
    streams = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
    marks = scratch.keep(streams.mapInArrow(_marks, "doc long, key long").distinct(), "marks")

    def met(texts: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows with a key (kind 0) and with a text (kind 1); every part of a document has all its keys."""
        nothing = F.lit(None)
        part = F.pmod(F.coalesce(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(0)), parts).cast("int")
        texts = texts.join(large, "doc", "left").withColumn("part", F.when(parts > 1, part).otherwise(0)).drop("parts")
        texts = texts.withColumn("kind", F.lit(1)).withColumn("key", nothing.cast("long"))
        every = F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
        keys = keys.join(large, "doc", "left").withColumn("part", every).drop("parts").withColumn("kind", F.lit(0))
        return texts.unionByName(keys, allowMissingColumns=True)

    ordered = met(read.select("doc", "text"), marks).repartitionByRange(tasks, "doc", "part").sortWithinPartitions("doc", "part", "kind")
    candidates = scratch.keep(ordered.mapInArrow(_candidates(buckets), PACKED), "candidates")
    scratch.drop("marks")

    streams = candidates.select("bucket", "first_doc", "hashes", "docs").repartition(tasks, "bucket").sortWithinPartitions("bucket", "first_doc")
    repeats = scratch.keep(streams.mapInArrow(_repeats, "doc long, key long"), "repeats")
    scratch.drop("candidates")

    texts = read.select("doc", "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ordered = met(texts, repeats).repartition(tasks, "doc", "part").sortWithinPartitions("doc", "part", "kind")
    return ordered.mapInArrow(_removed, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the repeated passages of ``documents``."""
    found = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select doc_id, i, array_to_string(w[i + 1:i + 13], ' ') as phrase
  from w, unnest(range(0, greatest(len(w) - 12, 0))) as t(i)
), m as (
  select doc_id, i, min(doc_id) over (partition by phrase) as least from g
), gone as (
  select distinct doc_id, i + j as p from m, unnest(range(0, 13)) as t(j) where least < doc_id
), p as (
  select w.doc_id, len(w.w) as n, i, w.w[i + 1] as word from w, unnest(range(0, len(w.w))) as t(i)
), k as (
  select p.doc_id, count(*) as n, count(gone.p) as n_removed,
         coalesce(string_agg(word, ' ' order by i) filter (gone.p is null), '') as kept
  from p left join gone on gone.doc_id = p.doc_id and gone.p = p.i group by p.doc_id
)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from w left join k using (doc_id)
"""
