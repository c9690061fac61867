import random
import re

import pytest
from auxograph.llm.decontamination import contamination, decontaminated


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((i, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in df.collect()), key=str)


def tables(seed):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(common) if r.random() < 0.7 else f"r{i}x{k}" for k in range(r.randrange(1, 40)))) for i in range(25)]
    items += [(90, items[3][1]), (91, None), (92, " !!! ")]
    docs = []
    for i in range(120):
        text = [r.choice(common) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1]
            w = (w or "").split()
            a = r.randrange(len(w) + 1)
            at = r.randrange(len(text) + 1)
            text[at:at] = w[a:] if r.random() < 0.5 else w
        docs.append((i, r.choice([" ", ", ", "-"]).join(text).replace("c1", "C1")))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_words": 60}, {"segment_bytes": 500}, {"block_words": 100, "segment_bytes": 2000}])
def test_like_brute_force(spark, documents, options):
    docs, items = tables(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(documents(docs), bench, **options)
    assert found(got) == brute(docs, items)
    for r in got.collect():
        assert sum(b - a for a, b in r.spans) == r.n_hit
    kept = decontaminated(documents(docs), bench, **options)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in brute(docs, items) if not x[4])


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = documents([(1, "delta x beta y alpha z gamma"), (2, "alpha " + "x " * 50 + "beta gamma delta"), (3, "so alpha beta gamma delta")])
    got = {r.doc_id: (r.items, r.near_items) for r in contamination(docs, bench, slop=6).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: (["1"], [])}


def test_documents_do_not_join(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = contamination(documents([(1, "one two"), (2, "three four")]), bench).collect()
    assert not any(r.n_hit for r in got)


def test_awkward_rows(spark, awkward, documents):
    bench = spark.createDataFrame([(1, "Odd TEXT"), (None, "the cat"), (2, ""), (1, "Odd TEXT")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(contamination(awkward, bench)) == brute(rows, [(1, "Odd TEXT"), (2, "")])
    assert decontaminated(awkward, bench).columns == awkward.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert found(contamination(awkward, empty)) == brute(rows, [])
    assert contamination(documents([]), bench).count() == 0


def test_proximity_stays_in_a_document(spark, documents):
    """Terms in neighbouring documents are not near each other, whichever is the rarest; in one document they are."""
    docs = documents([(1, "one two three"), (2, "four five common common"), (3, "common five x four y one two")])
    items = spark.createDataFrame([("b", "one two three four five"), ("c", "common five")], "item_id string, text string")
    for slop in (2, 30):
        near = {r.doc_id: list(r.near_items) for r in contamination(docs, items, slop=slop).collect()}
        assert near == {1: [], 2: ["c"], 3: []}
    docs = documents([(1, "a b c x d"), (2, "e"), (3, "e x a b c d"), (4, "d c b a e")])
    items = spark.createDataFrame([("i", "a b c d e")], "item_id string, text string")
    near = {r.doc_id: list(r.near_items) for r in contamination(docs, items, slop=2).collect()}
    assert near == {1: [], 2: [], 3: ["i"], 4: ["i"]}
