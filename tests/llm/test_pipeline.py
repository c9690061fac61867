import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_classifiers import slow_quality
from test_decontamination import brute as contaminated
from test_mixing import targets, words
from test_near_dedup import brute as components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a brute-force version on its own input; the last against the mix."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas()) if name != "token_store" else stage(spark, docs, SF)
        seen[name] = (before, docs)
        assert name == "token_store" or docs.columns == columns

    before, after = seen["quality"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    _, score = slow_quality(rows)
    sure = {i: s > 0.5 for (i, _), s in zip(rows, score) if abs(s - 0.5) > 0.01}
    left = {r.doc_id for r in after.collect()}
    assert len(sure) > 0.95 * len(rows) and {i for i, clean in sure.items() if clean} == left & set(sure) and len(left) < len(rows)

    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, c in components(rows).values()} and after.count() < len(rows)

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {x[0] for x in contaminated([(r.doc_id, r.text) for r in before.collect()], items) if not x[4]}
    assert {r.doc_id for r in after.collect()} == want

    before, after = seen["mixing"]
    rows, made = before.collect(), defaultdict(list)
    for r in after.collect():
        made[r.doc_id].append(words(r.text))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    wanted = targets(sizes)
    place = Counter()
    key = lambda r: hashlib.md5(f"mix:{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
    for r in sorted(rows, key=key):
        budget, n = int(wanted[r.source] + 1e-9), words(r.text)
        cut = max(0, min(budget % sizes[r.source] - place[r.source], n))
        place[r.source] += n
        assert sorted(made[r.doc_id]) == sorted(x for x in [n] * (budget // sizes[r.source]) + [cut] if x)

    before, after = seen["token_store"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = [[*plain.encode(r.text, add_special_tokens=False).ids, 0] for r in sorted(before.collect(), key=lambda r: (r.doc_id, r.text))]
    want = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in encoded]
    assert [(r.n_tokens, r.ids_crc32) for r in after.orderBy("start").collect()] == want


def test_run_and_tables(spark, documents):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    # of the stages' own tables only the last stage's and its input are left
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    (root,) = [x for x in os.listdir(shared) if x.startswith("pipeline-") and not x.startswith("pipeline-tokens")]
    assert os.listdir(f"{shared}/{root}") == ["mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def internal_names():
    """All names that the stages' modules could give to columns: their string literals that are identifiers, and some of old."""
    from auxograph.llm import components, decontamination, mixing, near_dedup, quality, shared

    found = {"_id", "_bad_id", "_stay"}
    for module in (components, decontamination, mixing, near_dedup, quality, shared):
        found |= set(re.findall(r"\"([A-Za-z_]\w*)\"", open(module.__file__).read()))
    taken = {"doc_id", "text", "source", "item_id"}
    return sorted({x.lower() for x in found} - taken)


def test_awkward_rows(spark, awkward):
    """Every stage takes nulls, repeated rows and clashing columns, and gives the values of the columns back."""
    from pyspark.sql import functions as F

    names = internal_names()
    assert {"_id", "_key", "row", "score", "kept", "stay", "_size", "hash", "_row"} <= set(names)
    own = awkward.select("doc_id", "text", "source").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, SF)
        rows = out.collect()
        assert name == "token_store" or (out.columns == own.columns and rows)
        for r in rows if name != "token_store" else []:
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in names)
        nothing = stage(spark, own.limit(0), SF)
        assert nothing.count() == 0
