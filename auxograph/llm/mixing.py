"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source the rows are range-partitioned by that key (the
keys are uniform, so equal key ranges hold equal numbers of rows, however large the source), sorted
inside each range, and numbered by the prefix sum of their word counts: sums of the ranges first,
then sums inside each range. A source's budget is cut exactly: ``budget div size`` whole epochs, and
of the next epoch the words before the cut.

Targets: the sources, ordered by name with null last, have weights that repeat a pattern, and share
all words by weight; no target exceeds ``max_epochs`` times its source, and the excess is shared
again by weight until none does. That fixed point is ``min(cap, level * weight)``; the level comes
from prefix sums over the sources in order of cap / weight, so no loop is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.llm.shared import BLANKS, Scratch, prefix_sums, spread, word_count

#: Rows that one key range is meant to hold.
RANGE_ROWS = 50_000
#: Keys at which sources are cut, one a source, up to which they are sent to the texts.
SENT_KEYS = 10_000
_KEY = ["_src_null", "_src"]


def _source_key(source_col: str) -> list[Column]:
    return [
        F.col(source_col).isNull().alias("_src_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
    ]


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source with ``source_size``.

    ``sizes`` has one row per source, so the windows below, which take all its rows together, see
    the number of sources and not of documents.
    """
    by_name = Window.orderBy(*_KEY)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("_n", F.row_number().over(by_name))
        .withColumn("weight", F.get(pattern, (F.col("_n") - 1) % len(weights)))
        .withColumn("_cap", (max_epochs * F.col("source_size")).cast("double"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # the level if exactly the sources before this one are capped; where it leaves this one uncapped
    # too many may have been capped, so the highest such level is the right one
    levelled = ranked.withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(since),
    )
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    level = F.coalesce(F.max(fits).over(everything), F.lit(0.0))
    return levelled.withColumn("target", F.least(F.col("_cap"), level * F.col("weight"))).select(
        *_KEY, "source_size", "weight", "target"
    )


def _random_key(id_col: str, text_col: str, seed: str) -> Column:
    """The hash-random key of a row: of its identifier and its text, so that rows of one identifier spread."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), of(id_col), F.lit(":"), F.md5(of(text_col).cast("binary"))).cast("binary"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_epochs: int, seed: str) -> DataFrame:
    """The rows of ``mixture`` with their source and random key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    slim = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *_source_key(source_col),
            word_count(text_col).alias("size"),
            _random_key(id_col, text_col, seed).alias("_key"),
        ),
        "slim",
    )
    # 12 bits of the key per digit triple; more ranges than rows / RANGE_ROWS, and than tasks
    ranges = max(2 * spread(spark), -(-slim.count() // RANGE_ROWS))
    width = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    ranged = slim.withColumn("_range", F.floor(width * F.lit(ranges) / F.lit(2**32)).cast("long"))
    sums = ranged.groupBy(*_KEY).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, max_epochs)
    placed = prefix_sums(ranged, _KEY, "_range", [F.col("_key"), F.col("size"), F.col("doc_id")], "size", "_before")
    # the plan per (source, range): as many rows as ranges, so a source with a third of all rows is
    # joined range by range and not as one key
    plan = ranged.select(*_KEY, "_range").distinct().join(targets, _KEY)
    budget = F.floor("target").cast("long")
    share = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    return (
        placed.join(plan, [*_KEY, "_range"])
        .withColumn("epochs", share.cast("long"))
        .withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("cut", F.greatest(F.lit(0), F.least(F.col("_rest") - F.col("_before"), F.col("size"))).cast("long"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("cut")).cast("long"))
    )


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, weight, target, epochs, cut, taken.

    ``epochs`` whole copies of the document and the first ``cut`` words of one more are in the mix;
    ``taken = epochs * size + cut``. The taken words of a source sum to ``floor(target)``.

    * A null text has size 0, as have empty and blank texts; they are returned with nothing taken.
    * A null source is a source of its own, after all others.
    * Rows that agree in identifier and text share one key and are interchangeable.
    * An empty table gives an empty result; if all sizes are 0 all targets are 0.
    * Other columns of ``docs`` are not read. Reruns agree: keys depend on seed, identifier and text.
    """
    planned = _planned(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    source = F.when(~F.col("_src_null"), F.col("_src")).alias("source")
    return planned.select("doc_id", source, "size", "source_size", "weight", "target", "epochs", "cut", "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs`` that the mix consists of, with all their columns, whatever their names: the words that ``mixture`` takes.

    A document comes once per epoch; the document at a source's cut comes once more with its first
    ``cut`` words, joined by one space. Documents of which nothing is taken do not come. Rows that
    agree in identifier, text and source are given as much as such rows are given together; null
    identifiers, texts and sources are matched like any value.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    alike = [*_KEY, "_key"]
    planned = scratch.keep(_planned(docs, id_col, text_col, source_col, weights, max_epochs, seed).select(*alike, "size", "epochs", "cut"), "planned")
    taken = planned.groupBy(*alike).agg(
        F.max("size").alias("_size"),
        F.max("epochs").alias("_epochs"),
        F.count_if(F.col("cut") == F.col("size")).alias("_full"),
        F.max(F.when(F.col("cut") < F.col("size"), F.col("cut"))).alias("_part"),
        F.count("*").alias("_rows"),
    )
    taken = taken.where("_size > 0 and (_epochs > 0 or _full > 0 or _part > 0)")
    # rows of one key all get the same but where the source's cut falls among them: one key a source
    uneven = (F.col("_rows") > 1) & (F.col("_full") < F.col("_rows")) & ((F.col("_full") > 0) | (F.col("_part") > 0))
    # the row travels in one struct, so that its names meet no others
    keys = [*_source_key(source_col), _random_key(id_col, text_col, seed).alias("_key")]
    keyed = docs.select(F.struct("*").alias("_row"), *keys)
    even = keyed.join(taken.where(~uneven), alike).withColumn("_nth", F.lit(1).cast("long"))
    given, cut_keys = even, scratch.keep(taken.where(uneven), "uneven")
    if n := cut_keys.limit(SENT_KEYS + 1).count():
        few = keyed.join(F.broadcast(cut_keys) if n <= SENT_KEYS else cut_keys, alike)
        few = scratch.keep(few.withColumns({"_place": F.spark_partition_id(), "_one": F.lit(1)}), "cut")
        numbered = prefix_sums(few, alike, "_place", [F.col("_key")], "_one", "_nth").withColumn("_nth", F.col("_nth") + 1)
        given = even.unionByName(numbered.drop("_place", "_one"))
    whole = F.col("_epochs") + (F.col("_nth") <= F.col("_full")).cast("long")
    part = (F.col("_nth") == F.col("_full") + 1) & (F.coalesce("_part", F.lit(0)) > 0)
    text = F.col(f"_row.`{text_col}`")
    words = F.split(F.regexp_replace(text, f"^[{BLANKS}]+", ""), f"[{BLANKS}]+")
    first = F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " ")
    given = given.withColumns({"_whole": whole, "_copies": whole + part.cast("long")}).where("_copies > 0")
    copies = given.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    cut = F.when(F.col("_copy") > F.col("_whole"), first).otherwise(text)
    return copies.select(*[(cut if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the mix of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n
  from d group by source
), w as (
  select *, [5.0::double, 2.0::double, 1.0::double][((n - 1) % 3 + 1)::int] as weight, (3 * source_size)::double as cap,
         (sum(source_size) over ())::double as total
  from s
), l as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, n rows between current row and unbounded following) as level
  from w
), t as (
  select source, source_size,
         least(cap, coalesce(max(case when level * weight <= cap then level end) over (), 0) * weight) as target
  from l
), p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.size, d.doc_id
                                    rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size::bigint as size, source_size, target,
       case when source_size = 0 then 0 else
         (budget // source_size) * size
         + greatest(0, least(budget - (budget // source_size) * source_size - before, size)) end::bigint as taken
from p
"""
