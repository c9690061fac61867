import hashlib
import re

import pytest
from auxograph.llm.exact_dedup import _rounds, exact_groups


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        flat = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(flat, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id, i))
    out = []
    for flat, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(flat.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_like_brute_force(documents):
    rows = [(i, ["a b", "ab", " ab\n", "abc", None, "", "\t"][i % 7] + str(i % 3) if i % 7 != 4 else None) for i in range(200)]
    for fan, leaves in ((2, 16), (4, 5), (8, 1), (16, 300)):
        got = exact_groups(documents(rows), fan=fan, leaves=leaves)
        assert found(got) == brute(rows)
        kept = got.where("kept").collect()
        assert len(kept) == len({r.text_sha256 for r in kept}) == len({r[3] for r in brute(rows)})


def test_awkward_rows(awkward):
    got = exact_groups(awkward)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert [x[2:] for x in found(got)] == [x[2:] for x in brute(rows)]
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in rows) == 1 for rows in by_text.values())
    cat = [rows for rows in by_text.values() if len(rows) == 3][0]
    assert {r.keep_id for r in cat} == {1}


def test_hot_group_and_empty_table(spark, documents):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(999)]
    assert found(exact_groups(documents(rows), leaves=64)) == brute(rows)
    assert exact_groups(documents([])).count() == 0
    with pytest.raises(ValueError):
        exact_groups(documents([]), fan=3)


def test_rounds():
    assert [_rounds(n, f) for n, f in ((1, 2), (2, 2), (3, 2), (8, 2), (9, 2), (64, 4), (65, 4), (4096, 16), (4097, 16))] == [1, 1, 2, 3, 4, 3, 4, 3, 4]
