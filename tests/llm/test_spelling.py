import re
import zlib
from collections import Counter

import numpy as np
import pytest
from auxograph.llm import spelling
from auxograph.llm.shared import Scratch
from hypothesis import given, settings
from hypothesis import strategies as st


def near(a, b):
    """Whether exactly one character is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    if len(long) != len(short) + 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at:] == long[at + 1 :]


def counted(rows, spoil=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    """(n, n_near, form, form_n, root) of each word."""
    form, out = {}, {}
    others = {w: [x for x in counts if near(w, x)] for w in counts}
    for w, xs in others.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(others[w]), form[w], counts.get(form[w]), root)
    return out


def told(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_near_words_share_exactly_one_key(a, b):
    met = 0
    for key, lo, hi in spelling.keys_of(a):
        for other, lo2, hi2 in spelling.keys_of(b):
            met += key == other and a != b and not (lo >= 0 and lo2 >= 0 and (lo > hi2 or lo2 > hi))
    assert met == near(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=63, max_size=67), st.data())
def test_keys_around_the_bound(a, data):
    """Keys that are texts and keys that are hashes meet as texts would."""
    i = data.draw(st.integers(0, len(a) - 1))
    for b in (a[:i] + a[i + 1 :], a[:i] + "c" + a[i + 1 :], a[:i] + "c" + a[i:]):
        shared = {k for k, *_ in spelling.keys_of(a)} & {k for k, *_ in spelling.keys_of(b)}
        assert shared
    assert not {k for k, *_ in spelling.keys_of(a)} & {k for k, *_ in spelling.keys_of(a + "cc")}


def test_random_words(spark):
    rng = np.random.default_rng(1)
    for alphabet in ("ab", "abéd"):
        words = {"".join(rng.choice(list(alphabet), rng.integers(0, 8))) for _ in range(400)}
        counts = {w: int(rng.integers(1, 2 ** rng.integers(1, 12))) for w in words}
        assert told(spelling.variants(table(spark, counts))) == brute(counts)


def test_long_chain_and_long_words(spark):
    """A path of forms with doubling counts, and words whose keys would be a square of their length."""
    chain = {"a" * (10 + i): 3 * 2**i for i in range(25)}
    long = "x" + "ab" * 20_000
    words = {long: 50, long + "z": 7, long[:-1]: 6, "y" + long[1:]: 5, long[:100] + "c" + long[101:]: 4, long[::-1]: 3, "b" * 64: 9, "b" * 65: 30, "b" * 66: 3}
    counts = chain | words
    got = told(spelling.variants(table(spark, counts)))
    assert got == brute(counts)
    assert got["a" * 10][4] == "a" * 34 and got["b" * 64][2] == "b" * 65 and got[long + "z"][2] == long


def test_a_key_of_many_words(spark):
    """All words that share a key: their number is bounded by the alphabet."""
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    counts = {f"wo{c}rd": 3 + i for i, c in enumerate(letters)} | {"word": 5, "words": 500}
    got = told(spelling.variants(table(spark, counts)))
    assert got == brute(counts) and got["woard"][1] == len(letters)


def test_roots(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 7) for i in range(50)]
    got = spelling.roots(spark.createDataFrame(links, "id long, up long"), Scratch(spark, "roots")).collect()
    assert {r.id: r.root for r in got} == dict.fromkeys([i for i, _ in links], 40)


def texts(seed):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdeé×ÀB"), rng.integers(4, 9))) for _ in range(150)]
    common = 1 / np.arange(1, len(stems) + 1)
    for i in range(80):
        yield i, " ".join(rng.choice(stems, 120, p=common / common.sum()))


def test_texts(spark, documents):
    rows = [*texts(2), (None, "Colour Colour COLOUR colour, color1color color-color"), (None, None), (3, "")]
    counts = counted(rows)
    docs = documents(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs, spoil=97).collect()} == counts
    assert counts != counted(rows, None) == {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert told(spelling.variants(spelling.word_counts(docs, spoil=97))) == brute(counts)
    found = spelling.variants(spelling.word_counts(docs, spoil=97))
    assert sum(r.n for r in spelling.groups(found).collect()) == sum(counts.values())


def test_awkward_rows(spark, awkward):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    clashed = awkward.withColumns({c: F.lit("clash") for c in ("word", "n", "h", "id", "up", "root", "form")})
    docs = clashed.unionByName(clashed).unionByName(clashed)
    assert told(spelling.variants(spelling.word_counts(docs, spoil=97))) == brute(counted(rows * 3))
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([("a", 4, "x"), ("", 1, "x"), (None, 9, "x"), ("b", None, "x")], "word string, n long, best string")
    assert told(spelling.variants(odd)) == brute({"a": 4, "": 1})
    with pytest.raises(ValueError):
        spelling.variants(odd, times=1)


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = spelling.query(spark, sf)
    want = db.execute(spelling.SQL)
    assert [d[0] for d in want.description] == got.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str) and any(r[1] for r in rows)
    stored = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {r[0]: r[3] for r in rows} == counted([tuple(r) for r in stored])
