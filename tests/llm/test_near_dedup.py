import random
import re

import numpy as np
import pytest
from auxograph.llm import near_dedup
from auxograph.llm.components import components, forest
from auxograph.llm.near_dedup import deduplicated, near_duplicates
from auxograph.llm.shared import Scratch


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id to (n_shingles, component), for unique identifiers."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y:
                shared = len(sets[x] & sets[y])
                if shared and 100 * shared >= 75 * len(sets[x] | sets[y]):
                    a, b = sorted((root(x), root(y)))
                    label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(seed, n, edits):
    """Texts that are copies of a few originals with some words changed."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = random.Random(i % 7)
        words = [f"w{own.randrange(500)}" for _ in range(40 + 30 * (i % 7))]
        for _ in range(r.randrange(edits)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words) if i % 5 else " ".join(words).upper()))
    return rows


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("seed", "edits"), [(1, 3), (2, 12)])
def test_like_brute_force(documents, seed, edits):
    rows = variants(seed, 120, edits)
    got = near_duplicates(documents(rows))
    assert found(got) == brute(rows)
    assert sorted(r.doc_id for r in got.where("kept").collect()) == sorted({c for _, c in brute(rows).values()})


def test_blocks_of_the_exhaustive_round(documents, monkeypatch):
    """With tiny blocks, cells and buckets a group is compared part by part, with the same result."""
    rows = variants(3, 90, 14)
    want = brute(rows)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    assert found(near_duplicates(documents(rows))) == want
    for name, size in (("BLOCK_ROWS", 3), ("CELL_ROWS", 4), ("BUCKET_ROWS", 2), ("SENT_NODES", 0)):
        monkeypatch.setattr(near_dedup, name, size)
    assert found(near_duplicates(documents(rows))) == want


def test_large_group_of_near_copies(documents):
    """2,000 near copies of one text, many of them with more changes than a link allows: no link is lost."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(r.randrange(7)):
            words[r.randrange(60)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    got, want = found(near_duplicates(documents(rows))), brute(rows)
    # two texts at the limit may lie outside of the radius with a chance of 2e-5, but here all have many links
    assert got == want and len({c for _, c in want.values()}) > 20


def test_chain_is_one_component(documents):
    """Neighbours are similar, the ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(words)))
        for k in range(4):
            words[(16 * i + 4 * k) % 200] = f"c{i}-{k}"
    assert found(near_duplicates(documents(rows))) == brute(rows)


def test_awkward_rows(awkward, documents):
    rows = {(r.doc_id, r.text or ""): r for r in near_duplicates(awkward).join(awkward.select("doc_id", "text").distinct(), "doc_id", "left").collect()}
    assert rows  # joins do not crash on nulls
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    cat = [r for r in got if r.n_shingles == 13]
    assert {r.component_id for r in cat} == {1} and sum(r.kept for r in cat) == 1
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in got if r.doc_id in (2, 3, 4))
    long = [r for r in got if r.doc_id == 7]
    assert long[0].n_shingles == 1
    kept = deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r.kept for r in got)
    assert near_duplicates(documents([])).count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    label = list(range(1100))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    want = {(i, root(i)) for i in range(1100) if root(i) != i}
    for tasks in (1, 3, 40):
        graph = spark.createDataFrame(pairs, "u long, v long").repartition(tasks)
        got = components(graph, Scratch(spark, "test"), "c").collect()
        assert len(got) == len(want) and {(g.node, g.root) for g in got} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), "c").count() == 0
    u, v = forest(*(np.array(x) for x in zip(*pairs)))
    assert set(zip(u.tolist(), v.tolist())) == want


def test_radius_is_guaranteed():
    """Any two signatures within the radius share a key."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    one = r.integers(0, 1 << 16, near_dedup.POSITIONS)
    for _ in range(200):
        two = one.copy()
        at = r.choice(near_dedup.POSITIONS, near_dedup.RADIUS, replace=False)
        two[at] ^= 1
        batch = pa.RecordBatch.from_pydict({"node": pa.array([0, 1]), "signature": pa.array([one.tolist(), two.tolist()], pa.list_(pa.int32()))})
        keys = next(near_dedup._keys(iter([batch])))
        by_node = [{k for k, n in zip(keys.column("key").to_pylist(), keys.column("node").to_pylist()) if n == i} for i in (0, 1)]
        assert by_node[0] & by_node[1]
