"""Near-duplicates: MinHash signatures, a multi-index Hamming join, links confirmed on full sets.

A document's set is that of its 5-word shingles; documents with equal sets form a class, and one of
each class goes on. Its signature has ``POSITIONS`` values of ``b`` = 16 bits, one of each MinHash
function; the distance of two signatures is the number of positions in which they differ, on average
``POSITIONS * (1 - J)``.

The join finds all pairs with a distance of at most ``RADIUS``. Positions are split into ``CHUNKS``
chunks of ``WIDTH``. By the pigeonhole principle a pair within the radius has a chunk with at most
``RADIUS div CHUNKS`` = 1 differing positions. So for every chunk and each choice of one position to
leave out, the other values are a key: two signatures that agree in the chunk but for one position
share a key, whichever it is. This misses no pair within the radius. The radius is 31 of 64: a pair
with a similarity of just 0.75 is farther with a chance of 2e-5 (it expects 16), one with 0.8 of 1e-7.

Buckets are not expanded into pairs. Links are confirmed on the full sets of the texts, and a pair
inside a known component needs no look, so the search goes by rounds:

1. of the pairs (smallest of a bucket, other) and (neighbours in a bucket), for each document the
   one with the least distance;
2. the others of these pairs that still join two components;
3. every pair of documents that meet in a bucket and are still in two components.

The third round is exhaustive, so no link between components is lost. A large group of near copies has
its stragglers, each of which may meet thousands of others in buckets and be similar to none of them;
so this round makes no table of pairs either. It goes by blocks: a node's home is its largest open
bucket, a home is cut into blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_SHINGLES`` shingles, and

* the Hamming join tells which blocks meet: the rows of an open bucket are compared by signature, the
  ones outside its most frequent component with all, in cells of at most ``CELL_ROWS`` rows a side. What
  leaves a cell are pairs of blocks that hold a pair within the radius and between components;
* for such a pair of blocks the shingle sets, 8 bytes a shingle, are compared by an inverted index of the
  two, between components only. That returns links.

Buckets, cells and blocks are all bounded, whatever the size of a group; the work grows with the number
of pairs between a group's stragglers and its members, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.llm.components import components
from auxograph.llm.shared import Scratch, importable, spread
from auxograph.llm.words import Words, chunks, mixed, windows

SHINGLE = 5
POSITIONS = 64
CHUNKS = 16
WIDTH = POSITIONS // CHUNKS
RADIUS = 2 * CHUNKS - 1
#: Rows and shingles of one block of the exhaustive round.
BLOCK_ROWS = 250
BLOCK_SHINGLES = 250_000
#: Rows of an open bucket that are compared with as many others at once.
CELL_ROWS = 2_000
#: Rows of a bucket in which neighbours are looked for together.
BUCKET_ROWS = 100_000
#: Nodes (24 bytes each) up to which the wanted ones are sent to where the texts are, and not the texts to them.
SENT_NODES = 500_000

_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, text by text, and their numbers.

    A text of fewer than 5 words, but not none, has its whole sequence as its one shingle.
    """
    words = Words(data, offsets, "not_blank")
    hashes, counts = words.hashes(lower=True), words.counts
    of = words.text_of_word()
    full = windows(hashes, SHINGLE)
    inside = of[: len(full)] == of[SHINGLE - 1 :] if len(full) else np.zeros(0, bool)
    shingles, owner = full[inside], of[: len(full)][inside]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = [windows(hashes[words.of[t] : words.of[t + 1]], int(counts[t]), seed=10 + int(counts[t]))[0] for t in short]
        shingles, owner = np.append(shingles, np.array(own, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        shingles, owner = shingles[order], owner[order]
    _, first = np.unique(mixed(shingles + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return shingles[first], np.bincount(owner[first], minlength=len(offsets) - 1)


def signatures(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``POSITIONS`` values of 16 bits for each set that begins at ``begin``."""
    out = np.empty((len(begin), POSITIONS), np.uint16)
    for k in range(POSITIONS):
        least = np.minimum.reduceat((shingles ^ _SALTS[k]) * _FACTORS[k], begin)
        out[:, k] = mixed(least) & np.uint64(0xFFFF)
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            shingles, n = shingle_sets(data, offsets)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            first, second = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            values = np.zeros((b - a, POSITIONS), np.uint16)
            if len(some):
                first[some] = np.add.reduceat(mixed(shingles + np.uint64(1)), begin)
                second[some] = np.add.reduceat(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                values[some] = signatures(shingles, begin)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")),
                    pa.array(n.astype(np.int64)),
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, (b - a + 1) * POSITIONS, POSITIONS, dtype=np.int32)),
                        pa.array(values.reshape(-1).astype(np.int32)),
                    ),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest_1", "digest_2", "signature"],
            )


PROFILE = "doc_id long, text_hash long, n_shingles long, digest_1 long, digest_2 long, signature array<int>"
CLASS = ["n_shingles", "digest_1", "digest_2"]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each signature: chunk and position left out in the high bits, three values below."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("signature").flatten().to_numpy().reshape(-1, POSITIONS).astype(np.int64)
        made = []
        for c in range(CHUNKS):
            own = values[:, c * WIDTH : (c + 1) * WIDTH]
            for left_out in range(WIDTH):
                key = np.full(len(values), c * WIDTH + left_out)
                for k in range(WIDTH):
                    if k != left_out:
                        key = (key << 16) | own[:, k]
                made.append(key)
        nodes = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(np.tile(nodes, len(made)))], names=["key", "node"])


def _similar(least_percent: int):
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column("text_a").cast(pa.large_string()), batch.column("text_b").cast(pa.large_string())])
            sets: list[np.ndarray] = []
            for _, _, data, offsets in chunks(both):
                shingles, n = shingle_sets(data, offsets)
                sets += np.split(shingles, np.cumsum(n)[:-1])
            good = []
            for i in range(batch.num_rows):
                x, y = sets[i], sets[batch.num_rows + i]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= least_percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles): the shingle set of each text, 8 bytes a shingle."""
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            shingles, n = shingle_sets(data, offsets)
            edges = np.concatenate([[0], np.cumsum(n)])
            raw = shingles.tobytes()
            sets = pa.array([raw[8 * x : 8 * y] for x, y in zip(edges[:-1], edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), sets], names=["node", "shingles"])


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A stream sorted by ``keys`` in whole cells: a table of some of them, and where each begins and the last ends."""
    left: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]) if left is not None else rows
        edges = _edges(rows, keys)
        if len(edges) > 1:
            yield rows.slice(0, int(edges[-1])).combine_chunks(), edges
        left = rows.slice(int(edges[-1]))
    if left is not None and left.num_rows:
        yield left.combine_chunks(), np.append(_edges(left, keys), left.num_rows)


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where cells begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j): pairs of blocks with rows within the radius and of two roots, from cells (key, p, q) of buckets."""
    for rows, edges in _cells(batches, ["key", "p", "q"]):
        signature = rows.column("signature").combine_chunks().flatten().to_numpy().astype(np.uint16).reshape(-1, POSITIONS)
        root, block, left = (rows.column(c).to_numpy() for c in ("root", "block", "straggler"))
        found: set[tuple[int, int]] = set()
        # cells of a few rows, all of them at once: each row with the d-th after it
        size = np.diff(edges)
        cell = np.repeat(np.arange(len(size)), size)
        few = size <= 16
        for d in range(1, int(size[few].max(initial=1))):
            a = np.flatnonzero(few[cell[:-d]] & (cell[:-d] == cell[d:]) & (root[:-d] != root[d:]))
            near = (signature[a] == signature[a + d]).sum(1) >= POSITIONS - RADIUS
            found.update(zip(block[a[near]].tolist(), block[a[near] + d].tolist()))
        for c in np.flatnonzero(~few):
            at = slice(int(edges[c]), int(edges[c + 1]))
            own, r, b = signature[at], root[at], block[at]
            for x in np.flatnonzero(left[at]):
                known = [j for i, j in found if i == b[x]] if len(found) < 10_000 else []
                others = np.flatnonzero((r != r[x]) & ~np.isin(b, known))
                near = (own[others] == own[x]).sum(1) >= POSITIONS - RADIUS
                found.update((int(b[x]), int(j)) for j in np.unique(b[others[near]]))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        low, high = pairs.min(1), pairs.max(1)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["i", "j"])


def _links_between(least_percent: int):
    """Links (a, b) between roots, from cells (i, j) of two blocks or one, with the sets of their rows."""

    def links(node: np.ndarray, root: np.ndarray, block: np.ndarray, sets: list[np.ndarray], two: bool) -> list[tuple[int, int]]:
        values, counts = np.unique(root, return_counts=True)
        if len(values) == 1:
            return []
        size = np.array([len(x) for x in sets])
        begin = np.cumsum(size) - size
        _, term, spread = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        posting = np.repeat(np.arange(len(sets)), size)[np.argsort(term, kind="stable")]
        at = np.cumsum(spread) - spread
        found = []
        # pairs inside the most frequent component need no look, and every other pair has an end outside of it
        for x in np.flatnonzero(root != values[counts.argmax()]):
            own = term[begin[x] : begin[x] + size[x]]
            own = own[spread[own] > 1]
            n = spread[own]
            if not len(n):
                continue
            place = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(posting[place], minlength=len(sets))
            good = (100 * shared >= least_percent * (size[x] + size - shared)) & (shared > 0) & (root != root[x])
            if two:
                good &= block != block[x]
            hits = np.flatnonzero(good)
            _, first = np.unique(root[hits], return_index=True)
            found += [(int(node[x]), int(node[y])) for y in hits[first]]
        return found

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _cells(batches, ["i", "j"]):
            i, j, node, root, block = (table.column(c).to_numpy() for c in ("i", "j", "node", "root", "block"))
            shingles = table.column("shingles").combine_chunks()
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles.slice(int(a), int(b - a))]
                found += links(node[a:b], root[a:b], block[a:b], sets, i[a] != j[a])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows


def _distance(x: str, y: str) -> Column:
    return F.expr(" + ".join(f"cast({x}[{k}] <> {y}[{k}] as int)" for k in range(POSITIONS)))


class _Search:
    """The rounds of confirming links between class representatives."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch, least_percent: int):
        self.docs, self.nodes, self.scratch, self.least_percent = docs, nodes, scratch, least_percent
        self.roots: DataFrame | None = None
        self.seen: DataFrame | None = None
        self.n = 0

    def with_distance(self, pairs: DataFrame) -> DataFrame:
        """Pairs within the radius, with their distance."""
        own = self.nodes.select("node", "signature")
        left = own.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
        right = own.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
        near = pairs.join(left, "a").join(right, "b").select("a", "b", _distance("sa", "sb").alias("distance"))
        return near.where(F.col("distance") <= RADIUS)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes that are not known to be in one component."""
        if self.roots is None:
            return pairs
        for side in ("a", "b"):
            root = self.roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
            pairs = pairs.join(root, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        return pairs.where("root_a <> root_b").drop("root_a", "root_b")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of pairs (a, b), and join the components of those that are similar."""
        self.n += 1
        pairs = self.scratch.keep(pairs.select("a", "b"), f"pairs-{self.n}")
        if not pairs.head(1):
            return
        wanted = self.scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"wanted-{self.n}")
        texts = self.scratch.keep(self.texts(wanted), f"texts-{self.n}")
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        # texts of b first: a is the smallest of a bucket, whose text would be copied for each of its pairs
        good = pairs.join(right, "b").join(left, "a").mapInArrow(_similar(self.least_percent), "a long, b long")
        links = self.scratch.keep(good, f"links-{self.n}")
        self.scratch.drop(f"texts-{self.n}", f"wanted-{self.n}")
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        self.join(links)

    def unseen(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``wanted``, a table that has been written."""
        named = wanted.join(self.nodes.select("node", "rep_id", "text_hash"), "node").withColumnRenamed("text_hash", "named_hash")
        if wanted.limit(SENT_NODES + 1).count() <= SENT_NODES:
            named = F.broadcast(named)
        same = self.docs["doc_id"].eqNullSafe(F.col("rep_id")) & (self.docs["text_hash"] == F.col("named_hash"))
        return self.docs.join(named, same).dropDuplicates(["node"]).select("node", "text")

    def join(self, links: DataFrame) -> None:
        """Join the components at the ends of links (a, b)."""
        if not links.head(1):
            return
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.roots is not None:
            edges = edges.unionByName(self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        self.roots = components(edges, self.scratch, f"components-{self.n}")

    def exhaust(self, buckets: DataFrame) -> None:
        """Find every link between two components whose ends meet in a bucket."""
        self.n += 1
        rows = buckets.select("key", "node")
        if self.roots is not None:
            rows = rows.join(self.roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        else:
            rows = rows.withColumn("root", F.col("node"))
        by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
        several = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
        several = several.where("roots > 1").select("key", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("others"))
        rows = self.scratch.keep(rows.join(several, "key"), "open")
        if not rows.head(1):
            return
        nodes = rows.groupBy("node").agg(F.max(F.struct("n", "key"))["key"].alias("home"), F.first("root").alias("root"))
        nodes = nodes.join(self.nodes.select("node", "n_shingles", "signature"), "node")
        parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
        # homes of several blocks; they are sent to their rows where they are few enough, as any is a hot key
        homes = nodes.groupBy("home").agg(parts.cast("int").alias("parts")).where("parts > 1")
        homes = self.scratch.keep(homes, "homes")
        if homes.limit(SENT_NODES + 1).count() <= SENT_NODES:
            homes = F.broadcast(homes)
        own = F.xxhash64("home", F.pmod(F.xxhash64("node", F.lit("block")), F.coalesce("parts", F.lit(1))))
        members = self.scratch.keep(nodes.join(homes, "home", "left").select("node", "root", own.alias("block"), "signature"), "members")

        # a bucket's rows outside of its main component, by p, meet all of its rows, by q
        part = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
        of = lambda count: F.pmod(F.xxhash64("node", F.lit("cell")), F.col(count)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        cell = lambda p, q, straggler: F.struct(p.alias("p"), q.alias("q"), straggler.alias("straggler"))
        straggler = F.col("root") != F.col("main")
        right = F.transform(upto("ps"), lambda p: cell(p, of("qs"), F.lit(False)))
        left = F.when(straggler, F.transform(upto("qs"), lambda q: cell(of("ps"), q, F.lit(True))))
        cells = F.when(F.col("ps") * F.col("qs") == 1, F.array(cell(F.lit(0), F.lit(0), straggler)))
        cells = cells.when(straggler, F.concat(left, right)).otherwise(right)
        placed = rows.select("key", "node", "main", part("others").alias("ps"), part("n").alias("qs")).join(members, "node")
        placed = placed.select("key", F.inline(cells), "root", "block", "signature")
        tasks = spread(self.scratch.spark)
        sorted_cells = placed.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")
        meeting = self.scratch.keep(sorted_cells.mapInArrow(_near_blocks, "i long, j long").distinct(), "meeting")
        if not meeting.head(1):
            return
        blocks = meeting.select(F.explode(F.array("i", "j")).alias("block")).distinct()
        wanted = self.scratch.keep(members.join(blocks, "block", "left_semi").select("node"), "wanted")
        sets = self.texts(wanted).mapInArrow(_sets, "node long, shingles binary")
        sets = self.scratch.keep(sets.join(members.drop("signature"), "node"), "sets")
        ends = meeting.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        placed = ends.join(sets, "block").repartition(tasks, "i", "j").sortWithinPartitions("i", "j")
        links = placed.select("i", "j", "block", "node", "root", "shingles").mapInArrow(_links_between(self.least_percent), "a long, b long")
        links = self.scratch.keep(links, f"links-{self.n}")
        self.scratch.drop("open", "homes", "members", "meeting", "wanted", "sets")
        self.join(links)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_percent: int = 75,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words at blanks. Two documents are linked when their
    shingle sets share at least ``least_percent`` percent of their union; ``component_id`` is the
    smallest identifier that can be reached over links, and one row of each component is kept, the
    one with that identifier.

    * A null, empty or blank text has no shingles, is linked with nothing and is kept.
    * Null identifiers come after all others: a component of such rows only has a null id. Rows
      that share the smallest identifier of a component are one kept and the others not, so of
      repeated rows one stays (an empty text is never linked, so its repeated rows all stay).
    * An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark, "near-dedup")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = read.withColumn("text_hash", F.xxhash64("text"))
    profiles = read.select("doc_id", "text_hash", "text").mapInArrow(_profiles, PROFILE)
    profiles = scratch.keep(profiles.withColumn("row", F.monotonically_increasing_id()), "profiles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("first")
    classes = profiles.where("n_shingles > 0").groupBy(*CLASS).agg(first)
    classes = classes.select(*CLASS, F.col("first.row").alias("row"))
    nodes = classes.join(profiles.select("row", "doc_id", "text_hash", "signature"), "row")
    nodes = scratch.keep(nodes.select(F.col("row").alias("node"), F.col("doc_id").alias("rep_id"), "text_hash", "signature", *CLASS), "nodes")

    # a bucket of many rows is cut for its neighbours, so no task holds a bucket; its smallest row joins the parts
    keyed = nodes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    sizes = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BUCKET_ROWS)
    shared = keyed.join(sizes, "key").select("key", "node", "head", F.pmod(F.xxhash64("node"), parts).alias("part"))
    in_part = Window.partitionBy("key", "part").orderBy("node")
    buckets = scratch.keep(shared.select("key", "node", "head", F.lag("node").over(in_part).alias("previous")), "buckets")

    search = _Search(read, nodes, scratch, least_percent)
    stars = buckets.select(F.explode(F.array_compact(F.array("head", "previous"))).alias("a"), F.col("node").alias("b")).where("a <> b")
    near = scratch.keep(search.with_distance(stars.distinct()), "near")
    best = near.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a"))
    search.confirm(best)
    search.confirm(search.unseen(search.apart(near)))
    search.exhaust(buckets)
    scratch.drop("buckets", "near")

    roots = nodes.select("node", "rep_id", *CLASS)
    if search.roots is not None:
        roots = roots.join(search.roots, "node", "left")
    else:
        roots = roots.withColumn("root", F.lit(None).cast("long"))
    roots = roots.withColumn("root", F.coalesce("root", "node"))
    heads = roots.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", F.col("node"))).alias("head"))
    named = roots.join(heads, "root").select(*CLASS, F.col("head.rep_id").alias("component_id"), F.col("head.node").alias("keeper"))
    return (
        profiles.select("doc_id", "text_hash", "row", *CLASS)
        .join(named, CLASS, "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            (F.coalesce("keeper", "row") == F.col("row")).alias("kept"),
        )
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Rows that agree in identifier and text are told apart by nothing else: as many of them stay as
    ``near_duplicates`` keeps.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    # a null identifier and the least long share a key; with equal texts they are one component anyway
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    stay = found.groupBy(key("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("n_rows")
    )
    # the row travels in one struct, so that its names meet no others
    rows = docs.select(F.struct("*").alias("row"), key(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    marked = rows.join(stay.where("stay > 0"), ["id", "hash"])
    # of rows that agree in both, all stay (texts without words) or one does: a first row is taken of a
    # key that is the row's own in the first case, and every task leaves out all but its first rows
    alone = F.when(F.col("stay") == F.col("n_rows"), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    first = F.row_number().over(Window.partitionBy("id", "hash", "alone").orderBy("id"))
    return marked.withColumn("alone", alone).withColumn("n", first).where("n = 1").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the near-duplicates of ``documents``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, array_to_string(w[i + 1:i + least(5, len(w))], ' ') as shingle
  from w, unnest(range(0, greatest(len(w) - 4, 1))) as t(i) where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 75 * (x.n + y.n - shared)
), edges as (
  select a, b from links union select b, a from links
), reach as (
  select doc_id as node, doc_id as label from documents
  union
  select e.b, r.label from reach r join edges e on e.a = r.node and r.label < e.b
), best as (
  select node, min(label) as component_id from reach group by node
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, best.component_id, best.component_id = w.doc_id as kept
from w left join n using (doc_id) join best on best.node = w.doc_id
"""
