import random
import re

import pytest
from auxograph.llm import substring_dedup
from auxograph.llm.substring_dedup import repeated_substrings


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """(doc_id, text) to (words removed, kept words), with nulls as the largest identifier."""
    rank = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < rank(i):
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


def passages(seed, n):
    r = random.Random(seed)
    shared = [[f"p{k}-{i}" for i in range(length)] for k, length in enumerate((12, 13, 14, 20, 60))]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randrange(5)):
            text += [f"u{r.randrange(10**9)}" for _ in range(r.randrange(30))]
            p = r.choice(shared)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            text += p if r.random() < 0.5 else p[a:b]
        rows.append((i * 13 % 1009, r.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(documents, seed):
    rows = passages(seed, 150)
    got = repeated_substrings(documents(rows))
    assert found(got) == brute(rows)
    for r in got.collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(b < c for (_, b), (c, _) in zip(r.spans, r.spans[1:]))


def test_small_batches(documents, monkeypatch):
    """Streams that are worked on in many small pieces give the same result."""
    monkeypatch.setattr(substring_dedup, "TOGETHER", 7)
    monkeypatch.setattr(substring_dedup, "PACK_BYTES", 300)
    rows = passages(3, 80)
    assert found(repeated_substrings(documents(rows))) == brute(rows)


def test_packs_and_parts(documents, monkeypatch):
    """Small packs, and rows of one identifier in many parts, give the same result."""
    monkeypatch.setattr(substring_dedup, "MOST_RUNS", 50)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 200)
    rows = passages(4, 60) + [(None if i % 2 else 40, t) for i, t in passages(5, 60)]
    assert found(repeated_substrings(documents(rows))) == brute(rows)


def test_largest_identifier_and_null(documents):
    text = " ".join(f"w{i}" for i in range(30))
    for rows in ([(None, text), (2**63 - 1, text)], [(2**63 - 1, text), (2**63 - 2, text), (None, text)], [(-(2**63), text), (5, text), (None, text)]):
        assert found(repeated_substrings(documents(rows))) == brute(rows)


def test_repetition_inside_a_document(documents):
    rows = [(1, "a b " * 40), (2, "a b " * 30 + "c"), (3, "z " * 13), (4, "y " * 5 + "z " * 12)]
    assert found(repeated_substrings(documents(rows))) == brute(rows)


def test_awkward_rows(awkward, documents):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(repeated_substrings(awkward)) == brute(rows)
    assert repeated_substrings(documents([])).count() == 0
    same = [(i, "one passage of more than thirteen words that every document of the table has in common here") for i in range(300)]
    assert found(repeated_substrings(documents(same))) == brute(same)
