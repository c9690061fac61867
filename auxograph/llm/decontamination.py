"""Benchmark decontamination by a distributed positional inverted index.

The training documents are indexed once. A task turns its documents, about ``segment_bytes`` of
text at a time, into an index segment: for each term the ascending list of its positions in the
segment, where consecutive documents are set apart by a gap that no window can bridge. Segments are
written to the shared folder, one row each; postings never move between tasks, so common terms make
no hot key. The benchmark is the query set: its windows go to every segment in blocks of bounded
size, and what comes back are the documents with matches. In a segment a window starts from the posting list of its rarest term, shifted by the term's
offset in the window, and is intersected with the shifted lists of its other terms in order of
rarity until a list is exhausted or all agree: what is left are the exact phrase matches. With
``slop`` set, windows whose terms all lie near a rarest term's position are returned as well.

Terms are 64-bit hashes of words. A phrase match needs all of its words to agree, so a wrong one
needs 13 simultaneous collisions at consecutive positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.llm.shared import Scratch
from auxograph.llm.words import Words, chunks, windows

#: Text of one index segment.
SEGMENT_BYTES = 8 << 20
#: Words of the benchmark that are sent to the segments together: 16 MB as hashes.
BLOCK_WORDS = 2_000_000

SEGMENT = T.StructType(
    [
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("text_hashes", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("gaps", T.ArrayType(T.IntegerType())),
    ]
)
HITS = T.StructType(
    [
        T.StructField("segment", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


def _segment(doc_ids: list, text_hashes: list, counts: list[np.ndarray], terms: list[np.ndarray], gap: int):
    """One row of the index. ``terms``: the words of all documents, in order."""
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    words = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(n_words)) * gap, n_words)
    order = np.argsort(words, kind="stable")
    words, at = words[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    return {
        "doc_ids": doc_ids,
        "text_hashes": text_hashes,
        "n_words": n_words.astype(np.int32),
        "terms": words[first].view(np.int64),
        "lengths": np.diff(first, append=len(words)).astype(np.int32),
        "gaps": gaps.astype(np.int32),
    }


def build_index(
    docs: DataFrame,
    scratch: Scratch,
    gap: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """The stored index of all words: one row per segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        marks: list = []
        counts: list = []
        terms: list = []
        size = 0

        def row():
            made = _segment(ids, marks, counts, terms, gap)
            kinds = {"doc_ids": pa.int64(), "text_hashes": pa.int64(), "n_words": pa.int32(), "terms": pa.int64(), "lengths": pa.int32(), "gaps": pa.int32()}
            arrays = []
            for name, kind in kinds.items():
                values = pa.array(made[name], kind)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

        for batch in batches:
            names, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            for a, b, data, offsets in chunks(batch.column("text")):
                found = Words(data, offsets, "alnum")
                ids += names[a:b]
                marks += hashes[a:b]
                counts.append(found.counts)
                terms.append(found.hashes(lower=True))
                size += len(data)
                if size >= segment_bytes:
                    yield row()
                    ids, marks, counts, terms, size = [], [], [], [], 0
        if ids:
            yield row()

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = read.withColumn("text_hash", F.xxhash64("text"))
    return scratch.keep(read.mapInArrow(segments, SEGMENT).withColumn("segment", F.monotonically_increasing_id()), "index")


class Queries:
    """The distinct windows of a block of benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        rows, owners = [], []
        for item, words in items:
            if not len(words):
                continue
            n = min(size, len(words))
            rows.append(np.lib.stride_tricks.sliding_window_view(words, n))
            owners += [item] * len(rows[-1])
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        starts = np.cumsum([0, *map(len, rows)])
        for n in sorted({r.shape[1] for r in rows}):
            alike = [i for i, r in enumerate(rows) if r.shape[1] == n]
            stack = np.concatenate([rows[i] for i in alike])
            whose = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in alike])
            distinct, inverse = np.unique(stack, axis=0, return_inverse=True)
            items_of: list[set] = [set() for _ in range(len(distinct))]
            for window, owner in zip(inverse.reshape(-1), whose):
                items_of[window].add(owners[owner])
            self.by_length.append((distinct, [sorted(x) for x in items_of]))


def _without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of ascending ``a`` that are in ascending ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a] if len(b) else a[:0]


def _near(lists: list[np.ndarray], reach: int, base: np.ndarray) -> np.ndarray:
    """Positions of the first list that have a position of every other list within ``reach`` in the same document."""
    left = lists[0]
    for other in lists[1:]:
        of = np.searchsorted(base, left, side="right")
        right = np.searchsorted(other, left)
        after, before = other[np.minimum(right, len(other) - 1)], other[np.maximum(right - 1, 0)]
        # documents follow each other, so if the nearest position is in another one, so are all beyond it
        own = lambda x: np.searchsorted(base, x, side="right") == of  # noqa: B023, E731
        left = left[((after >= left) & (after - left <= reach) & own(after)) | ((before <= left) & (left - before <= reach) & own(before))]
        if not len(left):
            break
    return left


def search_segment(row: dict, queries: Queries, gap: int, slop: int | None):
    """(place, spans hit, items found, items found nearby) of the documents of a segment that have any."""
    n_words = np.asarray(row["n_words"], np.int64)
    base = np.concatenate([[0], np.cumsum(n_words + gap)])
    terms = np.asarray(row["terms"], np.int64).view(np.uint64)
    lengths = np.asarray(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    gaps = np.asarray(row["gaps"], np.int64)
    lists: dict[int, np.ndarray] = {}

    def positions(term: int) -> np.ndarray:
        if term not in lists:
            lists[term] = np.cumsum(gaps[ends[term] - lengths[term] : ends[term]])
        return lists[term]

    covered = np.zeros(base[-1] + 1, np.int32)
    items: dict[int, set] = {}
    near: dict[int, set] = {}
    for wanted, owners in queries.by_length if len(terms) else []:
        place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        for i in np.flatnonzero((terms[place] == wanted).all(axis=1)):
            offsets = np.argsort(lengths[place[i]], kind="stable")
            found = None
            for j in offsets:
                shifted = positions(place[i, j]) - j
                found = shifted if found is None else _without(found, shifted)
                if not len(found):
                    break
            if len(found):
                found = found[found >= 0]
                np.add.at(covered, found, 1)
                np.add.at(covered, found + wanted.shape[1], -1)
                for d in np.unique(np.searchsorted(base, found, side="right") - 1).tolist():
                    items.setdefault(d, set()).update(owners[i])
            if slop is not None:
                rare = list(dict.fromkeys(place[i, j] for j in offsets))
                hits = _near([positions(t) for t in rare], wanted.shape[1] - 1 + slop, base)
                for d in np.unique(np.searchsorted(base, hits, side="right") - 1).tolist():
                    near.setdefault(d, set()).update(owners[i])
    hit = np.cumsum(covered[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans: dict[int, list] = {}
    for a, b in edges.reshape(-1, 2):
        d = int(np.searchsorted(base, a, side="right")) - 1
        spans.setdefault(d, []).append([int(a - base[d]), int(b - base[d])])
    for d in sorted({*items, *near}):
        own = items.get(d, set())
        yield d, spans.get(d, []), sorted(own), sorted(near.get(d, set()) - own)


def search(index: DataFrame, queries: Queries, gap: int, slop: int | None = None) -> DataFrame:
    """The matches of one block of queries: a row per document that has any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.list_(pa.string())]
        schema = pa.schema(list(zip(HITS.names, [pa.int64(), pa.int32(), *lists])))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("n_words", "terms", "lengths", "gaps")}
                segment = batch.column("segment")[i].as_py()
                rows = [dict(zip(HITS.names, (segment, *x))) for x in search_segment(row, queries, gap, slop)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return index.select("segment", "n_words", "terms", "lengths", "gaps").mapInArrow(found, HITS)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items with their words' hashes, in blocks of about ``most`` words; one block is held at a time."""
    block: list = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for row in rows.where(F.col("item").isNotNull()).toLocalIterator():
        for _, _, data, offsets in chunks(pa.array([row["text"]], pa.string())):
            words = Words(data, offsets, "alnum").hashes(lower=True)
            block.append((row["item"], words))
            size += len(words)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    slop: int | None = None,
    block_words: int = BLOCK_WORDS,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, spans, items, near_items, contaminated.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A
    window is ``window`` consecutive words of an item, or the whole item if it has fewer. ``spans``
    are the word ranges [start, end) inside occurrences of windows, ``items`` the items with such
    windows. A document is contaminated when at least a twentieth of its words are hit.

    * A null or empty text has no words and is never contaminated; nor does an item without words
      match anything. Items with a null identifier are not part of the benchmark.
    * Items with the same text are all reported; repeated items count once.
    * Repeated rows of ``docs`` and null identifiers are each answered by a row of their own.
    * An empty benchmark hits nothing; empty documents give an empty result.
    * Columns of the same name in the two tables do not meet.

    The index holds all words, whatever the benchmark; a benchmark of more than ``block_words`` words is
    searched block by block in it.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    index = build_index(docs, scratch, window, id_col, text_col, segment_bytes)
    hits = None
    for n, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        part = scratch.keep(search(index, Queries(block, window), window, slop), f"hits-{n}")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], HITS)
    columns = F.arrays_zip("doc_ids", "text_hashes", "n_words")
    documents = index.select("segment", F.posexplode(columns).alias("place", "doc")).select(
        "segment", "place", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.text_hashes").alias("text_hash"), F.col("doc.n_words").cast("long").alias("n_words")
    )
    found = documents.join(_merged(hits), ["segment", "place"], "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    hits = found.select("doc_id", "text_hash", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), empty("spans", "array<array<int>>"), empty("items", "array<string>"), empty("near_items", "array<string>"))
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return hits.withColumn("contaminated", share)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names."""
    found = contamination(docs, benchmark, id_col, text_col, **options)
    bad = found.where("contaminated").select("doc_id", "text_hash").distinct()
    # the row travels in one struct, so that its names meet no others
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(bad, same, "left_anti").select("row.*")


def _merged(hits: DataFrame) -> DataFrame:
    """The matches of all blocks, a row per document: spans that overlap or touch are one."""
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    grouped = hits.groupBy("segment", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), together("items"), together("near_items"))
    last = lambda done: F.element_at(done, -1)
    union = F.aggregate(
        "spans",
        F.array().cast("array<array<int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (last(done)[1] >= s[0]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last(done)[0], F.greatest(last(done)[1], s[1])))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return grouped.select("segment", "place", union.alias("spans"), "items", F.array_except("near_items", "items").alias("near_items"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: ``documents`` against ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x{30}-\x{39}\x{41}-\x{5A}\x{61}-\x{7A}\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') as w0
  from documents
), d as (
  select doc_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from dw
), bw as (
  select item_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x{30}-\x{39}\x{41}-\x{5A}\x{61}-\x{7A}\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') as w0
  from benchmark
), b as (
  select item_id, list_transform(w0, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from bw
), q as (
  select distinct item_id, array_to_string(w[i + 1:i + least(13, len(w))], ' ') as phrase, least(13, len(w)) as n
  from b, unnest(range(0, greatest(len(w) - 12, 1))) as t(i) where len(w) > 0
), sizes as (
  select distinct n from q
), dwin as (
  select doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') as phrase
  from d, sizes, unnest(range(0, greatest(len(w) - n + 1, 0))) as t(i)
), h as (
  select dwin.doc_id, dwin.i, dwin.n, q.item_id from dwin join q on dwin.phrase = q.phrase and dwin.n = q.n
), c as (
  select doc_id, count(distinct i + j) as n_hit from h, unnest(range(0, n)) as t(j) group by doc_id
), it as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items
  from h group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(it.n_items, 0)::bigint as n_items,
       sha256(coalesce(it.items, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""
