import hashlib
import re
from collections import defaultdict

import pytest
from auxograph.llm import mixing
from auxograph.llm.mixing import mixed_documents, mixture


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over the cap shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    left = total
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("counts", [{"a": 30, "b": 5, "c": 80, None: 3, "d": 1}, {"x": 10}, {"a": 1, "b": 400}])
def test_targets_and_cut(documents, counts):
    rows = [(1000 * j + i, "w " * (1 + (i * 7 + j) % 13), s) for j, (s, n) in enumerate(counts.items()) for i in range(n)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    got = mixture(documents(rows)).collect()
    want = targets(sizes)
    taken = defaultdict(int)
    before = defaultdict(int)
    text = {i: hashlib.md5(t.encode()).hexdigest() for i, t, _ in rows}
    for r in sorted(got, key=lambda r: hashlib.md5(f"mix:{r.doc_id}:{text[r.doc_id]}".encode()).hexdigest()):
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        budget = int(r.target + 1e-9)
        rest = budget - budget // r.source_size * r.source_size
        assert r.taken == budget // r.source_size * r.size + max(0, min(rest - before[r.source], r.size))
        before[r.source] += r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixture(documents(list(reversed(rows))).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_documents_of_the_mix(documents):
    rows = [(i, f"t{i} " + "x " * (i % 9), "abc"[i % 3]) for i in range(90)]
    got = mixture(documents(rows)).collect()
    mixed = mixed_documents(documents(rows)).collect()
    by_id = defaultdict(int)
    for r in mixed:
        by_id[r.doc_id] += words(r.text)
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(by_id)
    assert sum(map(words, (r.text for r in mixed))) == sum(r.taken for r in got)


@pytest.mark.parametrize("sent", [10_000, 0])
def test_repeated_identifiers(documents, monkeypatch, sent):
    """Rows of one identifier, or of none, are given the words that the mix takes, alike or not."""
    monkeypatch.setattr(mixing, "SENT_KEYS", sent)
    same = [(5, "five words are in here", "a")] * 40 + [(None, "and of these there are six", "b")] * 30 + [(5, f"n{i} " * 3, "a") for i in range(20)]
    rows = [*same, *((None, None, "a"),) * 3, *((i, "z " * (i % 7), "c") for i in range(60)), (7, "a b c", None), (7, "a b c", None)]
    for weights in ((5, 2, 1), (1, 1, 9), (3, 7, 2)):
        plan = mixture(documents(rows), weights=weights).collect()
        taken, made = defaultdict(int), defaultdict(int)
        for r in plan:
            taken[r.doc_id, r.source] += r.taken
        for r in mixed_documents(documents(rows).repartition(3), weights=weights).collect():
            made[r.doc_id, r.source] += words(r.text)
        assert {k: v for k, v in taken.items() if v} == {k: v for k, v in made.items() if v}


def test_awkward_rows(awkward, documents):
    got = mixture(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4))
    assert mixed_documents(awkward).columns == awkward.columns
    assert mixture(documents([])).count() == 0
    nothing = mixture(documents([(1, None, "a"), (2, " ", "b")])).collect()
    assert [r.target for r in nothing] == [0.0, 0.0] and not any(r.taken for r in nothing)


def test_no_python_in_the_plan(documents):
    plan = mixture(documents([(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
