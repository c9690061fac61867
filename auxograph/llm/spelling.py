"""Spelling variant grouping: a symmetric-delete join.

Words at distance one (one character inserted, deleted or replaced) always share a key, if every word
emits itself and its distinct single deletions: of an insertion, the shorter word itself; of a
replacement, what both leave when the replaced character goes. So near words are found by an
equi-join on keys, and by exactly one key a pair:

* a word's own text and another's deletion are equal: the other has one character more;
* deletions of both are equal, and the runs of equal characters that they were taken from overlap: at
  a place in both runs the words differ, and elsewhere nowhere. If the runs don't overlap the words are
  further apart (``ab`` and ``ba`` share ``a`` and ``b``), and the pair is dropped.

A key of m characters is emitted by itself and by words with one character more, at most (m + 1) times
the size of the alphabet (90), so no key is shared by more words than that, however many words there are.

Then every word takes as its form the most frequent of its near words, if that is at least twice as
frequent, and roots come from joining forms with forms of forms: each round doubles the steps, and the
frequencies along a path double, so a handful of rounds suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxograph.llm.shared import CRC32_TABLE, Scratch, crc32_sql, importable
from auxograph.llm.words import mixed

#: Words of at least so many characters and occurrences are looked at.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as its word.
TIMES = 2
#: Keys of more characters are emitted as hashes, and longer words looked up by their numbers.
LONG_KEY = 64
LETTERS = r"[a-zÀ-ÿ]+"
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters (A-Z lower-cased, and U+00C0 to U+00FF) of all texts, and how often each comes.

    With ``spoil`` known damage is done first: where it divides h, the CRC-32 of ``identifier:run``, the
    run loses its character at h modulo its length. A null text has no words, a null identifier is
    empty; repeated rows count each; an empty table has no words. Counts are summed up in every task
    before words are exchanged, so a frequent word is no large group.
    """
    lowered = F.translate(F.col(text_col), _A_TO_Z, _A_TO_Z.lower())
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"),
    ).where(F.length("word") >= least_length)
    if spoil:
        h = F.crc32(F.concat("doc_id", F.lit(":"), "word").cast("binary"))
        runs = runs.select("word", h.alias("h"))
        place = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % spoil == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _runs(word: str) -> list[tuple[int, int]]:
    """First and last place of each run of equal characters."""
    starts = [i for i in range(len(word)) if i == 0 or word[i] != word[i - 1]]
    return list(zip(starts, [s - 1 for s in starts[1:]] + [len(word) - 1]))


def _hashed(word: str, starts: np.ndarray) -> tuple[str, list[str]]:
    """Two 64-bit hashes, as text, of the word and of what is left without each of the places ``starts``."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    whole, left = [], []
    for seed in (1, 2):
        values = mixed(points * np.uint64(2 * seed + 1) + np.uint64(seed << 40))
        base = int(mixed(np.array([seed], np.uint64))[0]) | 1
        powers = np.full(len(word), base, np.uint64)
        powers[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(powers))])
        shift = np.uint64(pow(base, -1, 1 << 64))
        whole.append(sums[-1:])
        left.append(sums[starts] + (sums[-1] - sums[starts + 1]) * shift)
    text = lambda pair, n: [f"#{n}:{a:016x}{b:016x}" for a, b in zip(*(x.tolist() for x in pair))]
    return text(whole, len(word))[0], text(left, len(word) - 1)


def keys_of(word: str) -> list[tuple[str, int, int]]:
    """The word's keys with the run that the deleted character is from; its own key has the run (-1, -1)."""
    runs = _runs(word)
    own, left = word, None
    if len(word) > LONG_KEY:
        own, left = _hashed(word, np.array([a for a, _ in runs]))
    if len(word) - 1 <= LONG_KEY:
        left = [word[:a] + word[a + 1 :] for a, _ in runs]
    return [(own, -1, -1), *((key, a, b) for key, (a, b) in zip(left, runs, strict=True))]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "lo", "hi", "id", "n", "word"]
    for batch in batches:
        rows: list[tuple] = []
        for id_, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            short = word if len(word) <= LONG_KEY else None
            rows.extend((*key, id_, n, short) for key in keys_of(word))
            if len(rows) > 50_000:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _distance_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts, of equal keys by hash, that are at distance one."""
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a_word").to_pylist(), batch.column("b_word").to_pylist(), strict=True):
            short, long = sorted((a, b), key=len)
            at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
            rest = short[at:] if len(short) < len(long) else short[at + 1 :]
            kept.append(len(long) - len(short) <= 1 and a != b and rest == long[at + 1 :])
        yield batch.filter(pa.array(kept, pa.bool_()))


def near_pairs(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, b_n, b_word) for every ordered pair of near words of ``vocabulary`` (id, word, n)."""
    keys = scratch.keep(vocabulary.select("id", "word", "n").mapInArrow(_keys, "key string, lo int, hi int, id long, n long, word string"), "keys")
    side = lambda p: keys.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("lo", "hi", "id", "n", "word")])
    apart = (F.col("a_lo") >= 0) & (F.col("b_lo") >= 0) & ((F.col("a_lo") > F.col("b_hi")) | (F.col("b_lo") > F.col("a_hi")))
    met = side("a").join(side("b"), "key").where((F.col("a_id") < F.col("b_id")) & ~apart)
    met = met.select("a_id", "a_n", "a_word", "b_id", "b_n", "b_word")
    if vocabulary.where(F.length("word") > LONG_KEY).head(1):
        # keys of long words are hashes, so their texts are fetched and compared
        met = scratch.keep(met, "met")
        known = F.col("a_word").isNotNull() & F.col("b_word").isNotNull()
        text = lambda p: vocabulary.select(F.col("id").alias(f"{p}_id"), F.col("word").alias(f"{p}_word"))
        fetched = met.where(~known).drop("a_word", "b_word").join(text("a"), "a_id").join(text("b"), "b_id").select(*met.columns)
        met = met.where(known).unionByName(fetched.mapInArrow(_distance_one, fetched.schema))
    return met.select(
        F.inline(
            F.array(
                F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("b_n").alias("b_n"), F.col("b_word").alias("b_word")),
                F.struct(F.col("b_id").alias("a"), F.col("a_id").alias("b"), F.col("a_n").alias("b_n"), F.col("a_word").alias("b_word")),
            )
        )
    )


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for ``links`` (id, up) without circles: where following ``up`` from each id ends."""
    now, round_ = scratch.keep(links.select("id", "up", F.lit(True).alias("open")), "links-0"), 0
    while now.where("open").head(1):
        further = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("open").alias("_open"))
        stepped = now.join(further, "up", "left").select("id", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("open"))
        round_ += 1
        now = scratch.keep(stepped, f"links-{round_}")
        scratch.drop(f"links-{round_ - 1}")
    return now.select("id", F.col("up").alias("root"))


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per row of ``counts`` (word, n; words are distinct): word, n, n_near, form, form_n, root.

    ``n_near`` is the number of words at distance one; ``form`` the most frequent of them (of equal ones
    the first in the order of code points), if it comes ``times`` times as often as the word, which must
    be above 1; ``root`` where forms of forms end, the word itself if it has none.

    * Rows with a null word or n are left out; an empty word is near words of one character. Other columns are not read.
    * A word of any length emits keys of bounded size. Long words (over 64 characters) that share a key
      are fetched to be compared. An empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its word")
    spark = counts.sparkSession
    importable(spark)
    scratch = Scratch(spark, "spelling")
    words = counts.where("word is not null and n is not null").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n"))
    vocabulary = scratch.keep(words, "vocabulary")
    best = F.min(F.struct((-F.col("b_n")).alias("neg"), F.col("b_word").alias("word"), F.col("b").alias("id"))).alias("best")
    found = near_pairs(vocabulary, scratch).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(found, "id", "left")
    enough = -F.col("best.neg") >= times * F.col("n")
    pick = lambda c: F.when(enough, c)
    formed = scratch.keep(
        joined.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            pick(F.col("best.word")).alias("form"), pick(-F.col("best.neg")).alias("form_n"), pick(F.col("best.id")).alias("up"),
        ),
        "formed",
    )
    scratch.drop("keys", "met")
    ends = roots(formed.where(F.col("up").isNotNull()), scratch)
    named = ends.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def groups(found: DataFrame) -> DataFrame:
    """(root, n_words, n): the groups of spellings that share a root, from the result of ``variants``."""
    return found.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: spelling variants among the words of ``documents``."""
    found = variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spoil=97))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _sql() -> str:
    h = crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")
    return rf"""
with recursive {CRC32_TABLE}, runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents
), hashed as (
  select run, c, {h} as h from (select doc_id, run, count(*) as c from runs where length(run) >= 5 group by doc_id, run), crc
), words as (
  select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(c)::bigint as n
  from hashed group by 1 having sum(c) >= 3 and length(word) >= 5
), keys as (
  select word, n, word as key from words
  union all
  select distinct word, n, left(word, i::int) || substr(word, i::int + 2) as key from words, unnest(range(0, length(word))) as t(i)
), near as (
  select distinct a.word, b.word as other, b.n
  from keys a join keys b on a.key = b.key and a.word <> b.word
  where length(a.word) <> length(b.word) and (a.key = a.word or b.key = b.word)
     or length(a.word) = length(b.word) and len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1
), best as (
  select word, count(*) as n_near, min({{'neg': -n, 'other': other}}) as top from near group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.neg >= 2 * w.n then top.other end as form,
         case when -top.neg >= 2 * w.n then -top.neg end as form_n
  from words w left join best using (word)
), walk as (
  select word, word as at, form from formed
  union all
  select walk.word, walk.form, f.form from walk join formed f on f.word = walk.form
)
select f.word, f.form, walk.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join walk on walk.word = f.word where walk.form is null
"""


SQL = _sql()
