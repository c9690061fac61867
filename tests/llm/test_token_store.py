import os
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from auxograph.llm import token_store
from auxograph.llm.shared import Scratch
from auxograph.llm.token_store import WordEncoder, read_tokens, token_offsets, write_tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


pieces = st.sampled_from(["a", "Bc", " ", "\n", "  ", "\t", "é", "字", "1", "'s", "<|endoftext|>", "\x1c", " ", "\0", "!", " the", "\r\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(pieces, max_size=12).map("".join), max_size=6))
def test_words_are_encoded_like_texts(texts):
    encode = WordEncoder(PATH, remembered=5)
    plain = Tokenizer.from_file(PATH) if not hasattr(test_words_are_encoded_like_texts, "t") else test_words_are_encoded_like_texts.t
    test_words_are_encoded_like_texts.t = plain
    for _ in range(2):
        assert encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


latin = st.sampled_from(["a", "St", "ñ", "ß", "ɏ", "\u0250", "ª", "ĸ", "ing", "'", "'s", "'LL", ".", ",", "!!", "###", "_", "`", "1", "²", "—", "я", "字", "\u0301"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.lists(latin, min_size=1, max_size=6).map("".join), max_size=8).map(" ".join), max_size=6))
def test_words_without_their_punctuation(texts):
    plain = Tokenizer.from_file(PATH) if not hasattr(test_words_without_their_punctuation, "t") else test_words_without_their_punctuation.t
    test_words_without_their_punctuation.t = plain
    encode = WordEncoder(PATH, remembered=5)
    for _ in range(2):
        assert encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_each_letter_and_end(plain):
    """Every letter that is encoded apart, beside each ASCII punctuation, and every white space that isn't cut at."""
    letters = [c for c in map(chr, range(0x600)) if c.isalnum()]
    texts = [f"a{c}{p} {c}{p}{p} {p}{c}b" for c in letters for p in string.punctuation]
    texts += [f"a.{c}b {c}c" for c in map(chr, range(1, 0x110000)) if c.isspace()]
    got = WordEncoder(PATH)(texts)
    assert got == [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_are_not_cut_by_the_tokenizer():
    """A word goes to the model once, whatever ends it; only ends and other words are cut by the tokenizer."""

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.characters = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode(self, text, **given):
            self.characters += len(text)
            return self.tokenizer.encode(text, **given)

        def encode_batch_fast(self, texts, **given):
            self.characters += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **given)

    encode = WordEncoder(PATH)
    counting = Counting(encode.tokenizer)
    for owner in (encode, getattr(encode, "words", None)):
        if owner is not None:
            owner.tokenizer = counting
    encode(["".join(f" wördя{chr(97 + i % 26)}{chr(97 + i // 26)}{end}" for i in range(600) for end in ("", ".", ",!!", "###"))[1:]])
    assert counting.characters <= 50


def check(spark, docs, rows, plain):
    path = Scratch(spark, "test-tokens").path("store")
    write_tokens(docs, path, PATH, files=3)
    got = token_offsets(spark, path).collect()
    start = 0
    want = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == want
    return path


def test_round_trip(spark, documents, plain):
    rows = [(i * 7 % 100, f"Document {i}\nsays <|endoftext|> " + "word " * i) for i in range(100)]
    path = check(spark, documents(rows), rows, plain)
    ids = read_tokens(spark, path, [13, 40]).orderBy("doc_id").collect()
    texts = dict(rows)
    assert [plain.decode(r.ids[:-1], skip_special_tokens=False) for r in ids] == [texts[13], texts[40]]
    assert [r.ids[-1] for r in ids] == [0, 0]


def test_files_ascend(spark, documents):
    path = Scratch(spark, "test-tokens").path("store")
    write_tokens(documents([(i, "x y") for i in range(50)]), path, PATH, files=4)
    parts = read_tokens(spark, path).groupBy("part").agg({"doc_id": "min", "seq": "max"}).orderBy("part").collect()
    lows = [r["min(doc_id)"] for r in parts]
    assert lows == sorted(lows) and len(parts) == 4


def test_awkward_rows(spark, awkward, documents, plain):
    check(spark, awkward, [(r.doc_id, r.text) for r in awkward.collect()], plain)
    path = Scratch(spark, "test-tokens").path("store")
    write_tokens(documents([]), path, PATH)
    assert token_offsets(spark, path).count() == 0


def test_rows_of_one_identifier_are_cut(spark, documents, plain, monkeypatch):
    """An identifier with many rows is spread over files, and the order stays."""
    monkeypatch.setattr(token_store, "RANGE_ROWS", 20)
    rows = [(7, f"text {i * 37 % 100:03d}") for i in range(100)] + [(None, f"none {i % 50}") for i in range(80)] + [(i, "x") for i in range(10)]
    path = check(spark, documents(rows), rows, plain)
    assert read_tokens(spark, path).where("doc_id = 7").select("part").distinct().count() > 1


def test_metadata(spark, documents):
    """Files have stripes, row indexes with statistics of identifiers and Bloom filters, and a reader prunes by them."""
    from py4j.java_gateway import get_field
    from pyarrow import orc

    path = Scratch(spark, "test-tokens").path("store")
    base = 1 << 40
    odd = [(base + 2 * i, " ".join(f"w{(i * j) % 977}" for j in range(60))) for i in range(12_000)]
    write_tokens(documents(odd), path, PATH, files=2, stripe_bytes=1 << 16)
    files = sorted(f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".orc"))
    assert len(files) == 2
    for name in files:
        file = os.path.join(path.removeprefix("file:"), name)
        found = orc.ORCFile(file)
        assert found.nstripes > 1 and found.compression == "ZSTD" and found.row_index_stride == token_store.INDEX_STRIDE
        # stripes are read alone and in parallel; together they are the file
        stripes = [found.read_stripe(i, columns=["doc_id", "n_tokens"]) for i in range(found.nstripes)]
        ids = [x for t in stripes for x in t.column("doc_id").to_pylist()]
        assert ids == sorted(ids) and len(ids) == found.nrows
        reader = spark._jvm.org.apache.orc.OrcFile.createReader(
            spark._jvm.org.apache.hadoop.fs.Path(file), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
        )
        assert reader.getStatistics()[3].getMinimum() == ids[0] and reader.getStatistics()[3].getMaximum() == ids[-1]
        rows = reader.rows(reader.options())
        for i, stripe in enumerate(reader.getStripes()):
            streams = {(s.getColumn(), s.getKind().toString()) for s in rows.readStripeFooter(stripe).getStreamsList()}
            assert {(3, "ROW_INDEX"), (3, "BLOOM_FILTER_UTF8")} <= streams
            kinds = [e.getKind().toString() for e in rows.readStripeFooter(stripe).getColumnsList()]
            assert kinds[3] == "DIRECT_V2" and kinds[6] == "DIRECT_V2"
        rows.close()
        # a search argument on the identifier reads whole row groups only where it may be
        build = lambda v: spark._jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder().equals("doc_id", spark._jvm.org.apache.hadoop.hive.ql.io.sarg.PredicateLeaf.Type.LONG, v).build()

        def rows_read(value):
            columns = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
            columns[0] = "doc_id"
            some = reader.rows(reader.options().searchArgument(build(value), columns))
            batch, n = reader.getSchema().createRowBatch(), 0
            while some.nextBatch(batch):
                n += get_field(batch, "size")
            some.close()
            return n

        assert 0 < rows_read(ids[len(ids) // 2]) <= token_store.INDEX_STRIDE
        assert rows_read(base - 5) == 0
        # an odd identifier lies between the statistics' ends, so it is the Bloom filter that skips
        assert sum(rows_read(ids[k] + 1) for k in range(50, 5_000, 500)) <= 2 * token_store.INDEX_STRIDE
    assert [r.doc_id for r in read_tokens(spark, path, [base + 24, base + 25, base + 600]).orderBy("doc_id").collect()] == [base + 24, base + 600]
