import re
from collections import Counter

import numpy as np
from auxograph.llm import quality_rules as rules
from auxograph.llm.words import chunks

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall("[^ \t\n\x0b\x0c\r]+", text or "")


def measured(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, in plain loops."""
    text, w = text or "", words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def verdict(text):
    """base_failed, and which rules reject the text."""
    n, chars, symbols, dup, repeated = measured(text)
    text, w = text or "", words(text)
    lines = [x.strip(BLANKS) for x in text.split("\n") if x.strip(BLANKS)]
    pairs = Counter(zip(w, w[1:]))
    known = {x for f in rules.FUNCTION_WORDS for x in (f, f[0].upper() * f[0].isascii() + f[0] * (not f[0].isascii()) + f[1:])}
    rejected = {
        "symbols": 10 * symbols > n,
        "word_length": not 2 * n <= chars <= 15 * n,
        "repeated_lines": 2 * dup > len(lines),
        "letters": 10 * sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", x)) for x in w) < 6 * n,
        "capitals": 2 * len(re.findall("[A-Z]", text)) > len(re.findall("[A-Za-z]", text)),
        "bullets": 10 * sum(x[0] in "-*" for x in lines) > 9 * len(lines),
        "ellipses": 10 * sum(x.endswith(("...", "…")) for x in lines) > 3 * len(lines),
        "one_pair": 4 * max(pairs.values(), default=0) > n,
        "no_function_words": n >= 100 and sum(x in known for x in w) < 2,
    }
    return n < 10 or 100 * repeated > 20 * n, {k for k, v in rejected.items() if v}


def made(seed, n=600):
    rng = np.random.default_rng(seed)
    parts = ["the", "of", "Und", "cat", "dog", "é", "字字", "|", "##", "$", "12", "a" * 40, "WORD", "x.", "y...", "z…", "-", "*"]
    for _ in range(n):
        some = rng.choice(parts, size=rng.integers(1, 9))
        texts = [str(rng.choice(some)) + str(rng.choice([" ", " ", "\n", "\t", " \n", "\x0c"])) for _ in range(rng.integers(0, 150))]
        yield "".join(texts)


FIXED = [
    "ALL CAPITALS AND MORE OF THEM IN A ROW OF TEN TWELVE",
    "- one of the\n- two of a\n* three in it\n - four and so\n- five to be sure",
    "it breaks off...\nand again ... \nthen the end of it is here and plain…",
    "a plain text of ten words that is all right here.",
    "\n".join("the of cat dog the cat of of dog dog cat the dog of the the cat cat dog the".split()),
    *(f"{' '.join(f'wort{i}' for i in range(k))}" for k in (9, 10, 99, 100)),
]


def test_against_loops(spark, documents):
    texts = [*made(1), *FIXED, None, "", " \n\t", "one two three four five six " * 4_000]
    got = rules.quality_rules(documents(list(enumerate(texts)))).select("row.doc_id", *rules.MEASURES, "base_failed", "kept").collect()
    for r in got:
        failed, rejected = verdict(texts[r.doc_id])
        assert tuple(r[1:]) == (*measured(texts[r.doc_id]), failed, not failed and not rejected), texts[r.doc_id]
    seen = Counter(x for t in texts for x in verdict(t)[1] if not verdict(t)[0])
    assert len(got) == len(texts) and set(seen) == set(rules.RULES)


def test_the_cascade_is_cut_short(documents):
    texts = [*made(2, 300), *FIXED]
    column = documents([(i, t) for i, t in enumerate(texts)]).toArrow()["text"].combine_chunks()
    for order in (list(rules.RULES.items()), list(rules.RULES.items())[::-1]):
        left, seen, kept = [t for t in texts if not verdict(t)[0]], Counter(), []
        for _, _, data, offsets in chunks(column):
            some = rules.Texts(data, offsets)
            some.measure()
            k, s = rules.cascade(some, order)
            kept += k.tolist()
            seen.update(s)
        assert kept == [not failed and not rejected for failed, rejected in map(verdict, texts)]
        for name, _ in order:
            assert seen[name] == len(left)
            left = [t for t in left if name not in verdict(t)[1]]


def test_order_by_rejections_per_cost(spark, documents):
    """A slow rule that rejects much comes after a fast one that rejects the same; one that rejects nothing is last."""
    import time

    def slow(texts):
        time.sleep(0.02)
        return texts.n % 2 == 0

    docs = documents([(i, "a plain text of ten words that is all right" + " here" * (i % 2 + 1)) for i in range(200)])
    mine = {"never": lambda t: t.n < 0, "slow": slow, "fast": lambda t: t.n % 2 == 0}
    assert [t["rule"] for t in rules.rule_order(docs, rules=mine)] == ["fast", "slow", "never"]
    assert {t["rule"]: t["rejects"] for t in rules.rule_order(docs, rules=mine)} == {"fast": 0.5, "slow": 0.5, "never": 0.0}
    assert rules.quality_rules(docs, rules=mine).where("kept").count() == 100


def test_awkward_rows(spark, awkward):
    clashed = awkward.withColumnRenamed("size", "seconds").withColumnRenamed("part", "base_failed").withColumnRenamed("node", "texts")
    rows = clashed.collect()
    got = rules.passing_documents(clashed)
    assert got.columns == clashed.columns
    key = lambda r: str(r)
    assert sorted(got.collect(), key=key) == sorted((r for r in rows if not verdict(r.text)[0] and not verdict(r.text)[1]), key=key)
    assert rules.quality_rules(clashed.limit(0)).count() == rules.passing_documents(clashed.limit(0)).count() == 0


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(db.execute(rules.SQL).fetchall())
    assert sorted(map(tuple, rules.query(spark, sf).collect())) == want and {r[-1] for r in want} == {True, False}
