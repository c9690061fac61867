"""Quality rules: a cascade that is cut short, with its rules in the order that pays most.

Every text is measured for what all rules build on (words, symbols, repeated lines, repeated runs of
words), and fails at once if it is too short or repeats itself too much. The others pass through the
rules one after the other, and a text that a rule rejects is seen by no later one.

The order doesn't change the verdict, which is that all rules agree, but it changes the work. So every
rule is first tried alone on a sample: its seconds a million bytes are its cost, the share of texts that
it rejects its selectivity, and the rules are taken in order of rejections per second.

All rules compare whole numbers, so the verdict has no rounding and SQL can express it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxograph.llm.shared import importable
from auxograph.llm.words import WORD_BYTES, Words, chunks, mixed, windows

#: A text with fewer words, or with more than this percentage of its words in repeated runs, fails at once.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of a run.
RUN = 5
#: Documents of the sample, and bytes of it that one task looks at.
SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 4 << 20
#: Frequent short words of the languages that are expected.
FUNCTION_WORDS = (
    "the of and to in a is it that for with as was on be by this from are or an at not he "
    "le la les de des du et un une en que qui dans pour par est au sur pas avec il "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es für "
    "el los las del y se con para su al lo como"
).split()

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _bytes(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


_SYMBOL = _bytes("#*$%&|<>")
_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ASCII = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER = _ASCII.copy()
_LETTER[0x80:] = True
_BULLET = _bytes("-*")
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True


class Texts:
    """Some texts, the words and lines in them, and what was measured of both; ``of`` is an index of texts.

    A selection of the texts shares the bytes and keeps what was measured of the selected ones.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.first, self.end = offsets[:-1], offsets[1:]
        words, lines = Words(data, offsets, "not_blank"), Words(data, offsets, "line")
        self.words = {"start": words.starts, "end": words.ends, "of": words.text_of_word(), "hash": words.hashes()}
        full = _between(WORD_BYTES["not_blank"][data], lines.starts, lines.ends) > 0
        self.lines = {"start": lines.starts[full], "end": lines.ends[full], "of": lines.text_of_word()[full], "hash": lines.hashes(seed=2)[full]}
        self.n, self.n_lines = self.per_text(self.words), self.per_text(self.lines)

    def per_text(self, runs: dict[str, np.ndarray], flag: np.ndarray | None = None) -> np.ndarray:
        """How many of the runs (for which ``flag`` holds) each text has; numbers in ``flag`` are summed."""
        of = runs["of"] if flag is None or flag.dtype != bool else runs["of"][flag]
        weight = flag if flag is not None and flag.dtype != bool else None
        return np.bincount(of, weight, len(self.first)).astype(np.int64)

    def selected(self, which: np.ndarray) -> Texts:
        found = object.__new__(Texts)
        found.data, found.first, found.end = self.data, self.first[which], self.end[which]
        found.n, found.n_lines = self.n[which], self.n_lines[which]
        place = np.cumsum(which) - 1
        for name in ("words", "lines"):
            runs = getattr(self, name)
            kept = which[runs["of"]]
            left = {k: v[kept] for k, v in runs.items()}
            left["of"] = place[left["of"]]
            setattr(found, name, left)
        for name in ("n_symbols", "n_dup_lines", "word_chars", "n_repeat_words"):
            setattr(found, name, getattr(self, name)[which])
        return found

    def count(self, runs: dict[str, np.ndarray], kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind each run has."""
        return _between(kind[self.data], runs["start"], runs["end"])

    def measure(self) -> None:
        words, lines = self.words, self.lines
        self.word_chars = self.per_text(words, words["end"] - words["start"] - self.count(words, _INNER))
        self.n_symbols = _between(_SYMBOL[self.data], self.first, self.end)
        self.n_dup_lines = self.n_lines - np.bincount(self.salted(lines, lines["hash"])[0], minlength=len(self.first))
        repeated = np.zeros(len(words["of"]) + 1, np.int64)
        runs = windows(words["hash"], RUN)
        inside = np.flatnonzero(words["of"][RUN - 1 :] == words["of"][: len(runs)]) if len(runs) else np.zeros(0, np.int64)
        key = mixed(runs[inside] + words["of"][inside].astype(np.uint64) * _GOLDEN)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(repeated, inside[twice], 1)
        np.add.at(repeated, inside[twice] + RUN, -1)
        self.n_repeat_words = self.per_text(words, np.cumsum(repeated)[:-1] > 0)

    def salted(self, runs: dict[str, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of the distinct hashes of each text, and how often each comes."""
        _, at, n = np.unique(mixed(hashes + runs["of"][: len(hashes)].astype(np.uint64) * _GOLDEN), return_index=True, return_counts=True)
        return runs["of"][at], n

    def top_pair(self) -> np.ndarray:
        """How often each text has its most frequent pair of neighbouring words."""
        pairs = windows(self.words["hash"], 2)
        of = self.words["of"]
        inside = of[1:] == of[: len(pairs)] if len(pairs) else np.zeros(0, bool)
        _, at, n = np.unique(mixed(pairs[inside] + of[: len(pairs)][inside].astype(np.uint64) * _GOLDEN), return_index=True, return_counts=True)
        top = np.zeros(len(self.first), np.int64)
        np.maximum.at(top, of[: len(pairs)][inside][at], n)
        return top


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _last_is(texts: Texts, ending: bytes) -> np.ndarray:
    """Which lines end in ``ending``, but for blanks."""
    lines, data = texts.lines, texts.data
    full = np.flatnonzero(WORD_BYTES["not_blank"][data])
    last = full[np.searchsorted(full, lines["end"]) - 1]
    found = last - len(ending) + 1 >= lines["start"]
    for i, byte in enumerate(reversed(ending)):
        found &= data[np.maximum(last - i, 0)] == byte
    return found


def _bulleted(texts: Texts) -> np.ndarray:
    lines, data = texts.lines, texts.data
    full = np.flatnonzero(WORD_BYTES["not_blank"][data])
    first = full[np.searchsorted(full, lines["start"])] if len(full) else lines["start"]
    return _BULLET[data[first]]


def _function_words(texts: Texts) -> np.ndarray:
    if "hashes" not in _known:
        words = pa.array([w[:1].upper() * up + w[:1] * (not up) + w[1:] for w in FUNCTION_WORDS for up in (False, True)])
        _known["hashes"] = np.concatenate([Words(d, o, "not_blank").hashes() for _, _, d, o in chunks(words)])
    return texts.per_text(texts.words, np.isin(texts.words["hash"], _known["hashes"]))


_known: dict[str, np.ndarray] = {}


def _capitals(texts: Texts) -> np.ndarray:
    return 2 * _between(_UPPER[texts.data], texts.first, texts.end) > _between(_ASCII[texts.data], texts.first, texts.end)


Rule = Callable[[Texts], np.ndarray]
#: The rules: which texts each rejects. All of them have ``LEAST_WORDS`` words at least.
RULES: dict[str, Rule] = {
    # more than a symbol to ten words
    "symbols": lambda t: 10 * t.n_symbols > t.n,
    # words of less than 2 or more than 15 characters on average
    "word_length": lambda t: (t.word_chars < 2 * t.n) | (t.word_chars > 15 * t.n),
    # more than half of the lines were there before
    "repeated_lines": lambda t: 2 * t.n_dup_lines > t.n_lines,
    # less than six words in ten have a letter
    "letters": lambda t: 10 * t.per_text(t.words, t.count(t.words, _LETTER) > 0) < 6 * t.n,
    # most ASCII letters are capitals
    "capitals": _capitals,
    # nine lines in ten begin with a list mark
    "bullets": lambda t: 10 * t.per_text(t.lines, _bulleted(t)) > 9 * t.n_lines,
    # three lines in ten break off
    "ellipses": lambda t: 10 * t.per_text(t.lines, _last_is(t, b"...") | _last_is(t, "…".encode())) > 3 * t.n_lines,
    # a pair of words is a quarter of the text
    "one_pair": lambda t: 4 * t.top_pair() > t.n,
    # a hundred words without two function words of any language
    "no_function_words": lambda t: (t.n >= 100) & (_function_words(t) < 2),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _base_failed(texts: Texts) -> np.ndarray:
    return (texts.n < LEAST_WORDS) | (100 * texts.n_repeat_words > MOST_REPEATED * texts.n)


def cascade(texts: Texts, rules: Sequence[tuple[str, Rule]]) -> tuple[np.ndarray, dict[str, int]]:
    """Which texts pass the base and all rules; and how many texts each rule has seen."""
    kept, seen = ~_base_failed(texts), {}
    left, at = (texts, np.arange(len(kept))) if kept.all() else (texts.selected(kept), np.flatnonzero(kept))
    for name, rule in rules:
        seen[name] = len(at)
        if not len(at):
            continue
        rejected = rule(left)
        if rejected.any():
            kept[at[rejected]] = False
            left, at = left.selected(~rejected), at[~rejected]
    return kept, seen


def _tried(rules: dict[str, Rule]):
    """Each rule alone on the sampled texts of a task that pass the base: seconds, bytes, texts, rejections."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, size, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0, 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                if size >= SAMPLE_BYTES:
                    break
                texts = Texts(data, offsets)
                texts.measure()
                texts = texts.selected(~_base_failed(texts))
                size, n = size + int((texts.end - texts.first).sum()), n + len(texts.n)
                for name, rule in rules.items():
                    began = time.perf_counter()
                    rejected[name] += int(rule(texts).sum())
                    seconds[name] += time.perf_counter() - began
        if n:
            columns = [list(rules), list(seconds.values()), [size] * len(rules), [n] * len(rules), list(rejected.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rule", "seconds", "bytes", "texts", "rejected"])

    return rows


def rule_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> list[dict]:
    """The rules in the order of the cascade: rule, cost (seconds a million bytes), rejects (share), per_second.

    ``sample_docs`` bounds the sample, which is chosen by a hash of the identifier; of it a task looks
    at ``SAMPLE_BYTES`` bytes. A rule that rejects nothing there comes last, the cheaper ones first.
    Without a sample the rules stay as given.
    """
    rules = RULES if rules is None else rules
    importable(docs.sparkSession)
    million = 1_000_000
    share = int(million * sample_docs / max(docs.count(), 1)) + 1
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("rules")), F.lit(million)) < share).select(F.col(text_col).alias("text"))
    tried = some.mapInArrow(_tried(rules), "rule string, seconds double, bytes long, texts long, rejected long")
    sums = tried.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "bytes", "texts", "rejected")]).collect()
    found = {r["rule"]: {"rule": r["rule"], "cost": 1e6 * r["seconds"] / max(r["bytes"], 1), "rejects": r["rejected"] / r["texts"]} for r in sums}
    told = [found.get(name, {"rule": name, "cost": 0.0, "rejects": 0.0}) for name in rules]
    for t in told:
        t["per_second"] = t["rejects"] / max(t["cost"], 1e-9)
    return sorted(told, key=lambda t: (-t["per_second"], t["cost"]))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: dict[str, Rule] | None = None,
    sample_docs: int = SAMPLE_DOCS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row (a struct of all its columns, or of ``columns``), the measures, base_failed and kept.

    Measures: n_words; word_chars (characters in words); n_symbols; n_dup_lines (lines with a word that
    were there before); n_repeat_words (words in runs of five that the text has twice).

    * A null, empty or blank text has no words, so it fails. A very long text is measured as a whole.
    * Repeated rows and rows with null identifiers are judged by their texts. Columns of ``docs`` of any
      name come back in ``row``. An empty table gives an empty result.
    * The order of the rules depends on measured times, the result doesn't.
    """
    rules = RULES if rules is None else rules
    ordered = [(t["rule"], rules[t["rule"]]) for t in rule_order(docs, id_col, text_col, rules, sample_docs)]
    names = ["row", *MEASURES, "base_failed", "kept"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for a, b, data, offsets in chunks(batch.column("text")):
                texts = Texts(data, offsets)
                texts.measure()
                kept, _ = cascade(texts, ordered)
                measured = [texts.n, texts.word_chars, texts.n_symbols, texts.n_dup_lines, texts.n_repeat_words, _base_failed(texts), kept]
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), *map(pa.array, measured)], names=names)

    carried = docs.columns if columns is None else columns
    passed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(text_col).alias("text"))
    added = [T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return passed.mapInArrow(judged, T.StructType([passed.schema["row"], *added]))


def passing_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with all their columns."""
    return quality_rules(docs, id_col, text_col, **options).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the rules' verdict on ``documents``."""
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), *MEASURES, "base_failed", "kept")


SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), runs as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as run, array_to_string(w[i:i + 1], ' ') as pair, len(w) as n from d, unnest(range(1, len(w))) as t(i)
), pairs as (
  select doc_id, max(n) as top_pair from (select doc_id, count(*) as n from runs group by doc_id, pair) group by doc_id
), counted as (
  select doc_id, i, count(*) over (partition by doc_id, run) as times from runs where i + 4 <= n
), repeated as (
  select doc_id, count(distinct i + j) as n_repeat_words from counted, range(0, 5) as t(j) where times > 1 group by doc_id
), m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines, coalesce(top_pair, 0) as top_pair,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) as lettered,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as ascii,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*]'))) as bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as ellipses,
         len(list_filter(w, lambda x: list_contains([{", ".join(f"'{w}'" for w in FUNCTION_WORDS)}], case when upper(x[1]) = x[1] and x[1] between 'A' and 'Z' then lower(x[1]) else x[1] end || x[2:]))) as function_words
  from d left join repeated using (doc_id) left join pairs using (doc_id)
), v as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * n_dup_lines > n_lines
            or 10 * lettered < 6 * n_words or 2 * upper > ascii or 10 * bullets > 9 * n_lines or 10 * ellipses > 3 * n_lines
            or 4 * top_pair > n_words or (n_words >= 100 and function_words < 2)) as kept
from v
"""
