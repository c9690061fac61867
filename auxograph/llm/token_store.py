"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

The documents are range-partitioned by identifier and sorted, then encoded in the sorted order, so
the shuffle carries texts and each file holds one ascending range of identifiers. One file row is
one document: ``(part, seq, doc_id, n_tokens, ids)``. ORC stores ``ids`` as one long run of integers
per stripe with run-length encoding version 2 (bit-packed at the width the ids need), keeps minimum
and maximum of ``doc_id`` for every file, stripe and row group, and a Bloom filter per row group.
A reader splits files at stripes, and a lookup by identifier skips files and stripes by the
statistics and row groups by the Bloom filter.

Encoding: a byte-level BPE splits a text before it merges, and a single space or line feed between
two other characters always starts a piece of its own or with the word after it. So a worker
encodes each distinct word once and joins the results; texts with any other white space, with runs
of blanks, or with the text of a special token are given to the tokenizer whole. Most of the
tokenizer's time goes into cutting a text, not into merging. A run of letters is one piece that ASCII
punctuation ends, so a word of Latin, Greek or Cyrillic letters goes to the tokenizer's model at
once, and without its punctuation.
"""

from __future__ import annotations

import codecs
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.llm.shared import Scratch, importable, prefix_sums, shuffles_freed, spread

#: Words that a worker remembers; the memory is emptied when it is full, which changes no result.
REMEMBERED_WORDS = 400_000
#: Characters of text that are encoded together.
CHUNK_CHARS = 1_000_000
#: Words that are longer are not remembered.
LONGEST_WORD = 200
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1_000
#: Rows of one identifier that need not be cut, and characters of a text that tell where they may be.
RANGE_ROWS = 100_000
BOUND_CHARS = 64

SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)

#: Latin, Greek and Cyrillic letters that every version of Unicode since 5.0 has; none has more than 2 bytes.
LETTERS = "A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0388-\u038A\u038C\u038E-\u03A1\u03A3-\u03CE\u0400-\u0481\u048A-\u0513"
LETTERS_END = 0x514
LETTERS_ONLY = re.compile(f" ?[{LETTERS}]+")
#: A text with any of these isn't cut: runs of blanks, what marks the cuts, other white space (none comes after U+3000).
UNCUT = ("  ", "\n\n", " \n", "\n ", "\0", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))

_encoders: dict[str, WordEncoder] = {}


class Words(dict[str, bytes]):
    """The ids of words without white space but a blank before them; a word that is asked for is encoded and remembered.

    Words are remembered in two generations: a word that a text needs moves to the young one, and
    when the young one is full it becomes the old one, so rare words are forgotten and frequent ones
    stay. What is remembered changes no result.
    """

    def __init__(self, tokenizer, remembered: int):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer, self.remembered = tokenizer, remembered
        self.old: dict[str, bytes] = {}
        self.tokenize = tokenizer.model.tokenize
        cuts = tokenizer.pre_tokenizer
        known = isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        self.letters = LETTERS_ONLY.fullmatch if known and tokenizer.normalizer is None else lambda word: None
        # the model's characters for the bytes of these letters, as the library writes them
        alphabet = ["\ufffe"] * 256
        if known:
            for c in map(chr, range(LETTERS_END)):
                for byte, character in zip(c.encode(), cuts.pre_tokenize_str(c)[0][0], strict=True):
                    alphabet[byte] = character
        self.alphabet = "".join(alphabet)

    def forget(self) -> None:
        """Begin a new generation if this one is full."""
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) <= LONGEST_WORD:
            self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        stem = word.rstrip(string.punctuation)
        if not self.letters(stem):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif len(stem) < len(word):
            return self[stem] + self[word[len(stem) :]]
        else:
            ids = [t.id for t in self.tokenize(codecs.charmap_decode(stem.encode(), "strict", self.alphabet)[0])]
        return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct word once."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words = Words(self.tokenizer, remembered)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pieces(self, text: str) -> list[str] | None:
        """Words with the space before them, and line feeds; None if the text can't be cut so."""
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, (*UNCUT, *self.special))):
            return None
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, odd, known = [], [], self.words.__getitem__
        for i, text in enumerate(texts):
            pieces = self._pieces(text) if text else []
            if pieces is None:
                odd.append(i)
                pieces = []
            self.words.forget()
            out.append(b"".join(map(known, pieces)))
        found = self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
        for i, x in zip(odd, found, strict=True):
            out[i] = np.array(x.ids, "<u4").tobytes()
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its words outlive a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at least one text and about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _writer_rows(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = encoder(path), 0
        for batch in batches:
            names, parts = batch.column("doc_id"), batch.column("part")
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                ids = [x + end for x in encode(texts[a:b])]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        parts.slice(a, b - a),
                        pa.array(np.arange(seq, seq + b - a, dtype=np.int64)),
                        names.slice(a, b - a),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    names=SCHEMA.names,
                )
                seq += b - a

    return rows


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
    stripe_bytes: int = STRIPE_BYTES,
) -> None:
    """Encode every whole text and write the ids to ``path``, in ascending order of identifier.

    * A null or empty text is written as the end id alone.
    * Null identifiers come last; rows that share an identifier come by text, so repeated rows are
      written as often as they come. Where more than ``RANGE_ROWS`` rows share one, files are also cut
      between the beginnings of their texts. Other columns of ``docs`` are not read.
    * An empty table writes a readable store without rows.
    """
    spark = docs.sparkSession
    importable(spark)
    by_id, by_text = F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = named.groupBy("doc_id").count().where(F.col("count") > RANGE_ROWS).head(1)
    bounds = [by_id, F.substring("text", 1, BOUND_CHARS).asc_nulls_first()] if shared else [by_id]
    ranged = named.repartitionByRange(files or spread(spark), *bounds).sortWithinPartitions(by_id, by_text)
    stored = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_writer_rows(tokenizer_path, end_id), SCHEMA)
    writer = stored.write.mode("errorifexists").format("orc").option("compression", "zstd").option("orc.stripe.size", str(stripe_bytes))
    writer = writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(INDEX_STRIDE))
    with shuffles_freed(spark):
        writer.save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, or those of ``doc_ids``: a filter that ORC answers from its metadata."""
    stored = spark.read.schema(SCHEMA).orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(np.diff(ids.offsets.to_numpy()))
        view = memoryview(flat.tobytes())
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(np.concatenate([[0], ends[:-1]]) if len(ends) else [], ends)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("part", "seq", "doc_id", "n_tokens")] + [pa.array(sums, pa.int64())],
            names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Read the store back: doc_id, start, n_tokens, ids_crc32 of each stored document.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken of the stored ids as
    little-endian unsigned 32-bit integers.
    """
    importable(spark)
    read = read_tokens(spark, path).mapInArrow(_digests, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    kept = Scratch(spark, "token-offsets").keep(read, "digests")
    return prefix_sums(kept, [], "part", [F.col("seq")], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: ``documents`` as token ids, read back from their files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = Scratch(spark, "token-store").path("store")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_offsets(spark, path)
