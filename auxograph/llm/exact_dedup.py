"""Exact deduplication by a tree-merge of sorted digest runs.

Each document becomes one entry (digest of its normalised text, its normalised length, its rank).
Entries start in ``fan ** rounds`` runs, chosen by a hash of their identifier. In round r the runs
whose addresses differ only in digit r form one merge group, and each of them sends its entries to
the member whose digit r equals digit r of the digest's hash; the receiver merges what it gets from
all ``fan`` members. This is the binomial exchange (``fan`` 2) with several of its rounds taken as one
multiway merge: by default the largest fan up to 16 that leaves ``ROUNDS`` rounds or more. At every level a
digest keeps one entry: the best one seen below it and the number of documents below it. After the
last round the address is a function of the digest alone, so all equal texts have met.

Then the winners go back down the same tree. At every level a digest has at most ``fan`` receivers
in a merge group, so no join sees more than ``fan`` rows of a key, whatever the size of a group of
copies; only at the leaves do documents look their run's entry up, and a group with a third of all
rows is spread over all runs there.

Every level is written, so a round reads the one below it and nothing else: as many exchanges up and
down as there are rounds, and a lost executor costs a part of one round. The merge of one level is a
``groupBy`` of (address, digest) with ``min`` of a struct, which Spark runs as a sort-based aggregate
on both sides of the exchange: the senders sort and pre-merge their runs, the receivers merge them,
and both spill. Equality is verified, not assumed: the key of a merge is SHA-256 of the normalised
text together with its length and an independent 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxograph.llm.shared import BLANKS, Scratch, spread

KEY = ["digest", "n_bytes", "check"]
#: Runs that a merge may take, and rounds that there are at least while there are enough runs.
FANS = (2, 4, 8, 16)
ROUNDS = 3


def normalised(text: Column) -> Column:
    """The text without any of space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", "")


def _rerouted(digit: int, fan: int) -> Column:
    """The address with its digit number ``digit`` replaced by that of the digest's hash."""
    bits, address = fan.bit_length() - 1, F.col("address")
    own = F.shiftrightunsigned("check", digit * bits).bitwiseAND(F.lit(fan - 1))
    old = F.shiftright(address, digit * bits).bitwiseAND(F.lit(fan - 1))
    return address + (own - old) * fan**digit


def _rounds(runs: int, fan: int) -> int:
    """Rounds after which ``runs`` runs are one, ``fan`` of them merged at a time."""
    rounds = 1
    while fan**rounds < runs:
        rounds += 1
    return rounds


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fan: int | None = None,
    leaves: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Two texts are equal when they agree after all blanks are deleted. The row with the most code
    points in its original text stays, then the one with the smallest identifier.

    * A null text counts as empty; all empty and all-blank texts form one group.
    * A null identifier sorts after all others; its ``keep_id`` is null only where every row of the
      group has a null identifier. Of rows that agree in identifier and length, one is kept
      (``kept`` is true once per group), so repeated rows are dropped like any copies.
    * An empty table gives an empty result. Other columns of ``docs`` are not read.

    ``leaves``: least number of runs; by default the session's number of shuffle partitions. ``fan``: runs
    that a merge takes; the result is the same for every fan.
    """
    if fan is not None and fan not in FANS:
        raise ValueError("fan must be 2, 4, 8 or 16")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    runs = leaves or spread(spark)
    fan = fan or max((f for f in FANS if _rounds(runs, f) >= ROUNDS), default=FANS[0])
    rounds = _rounds(runs, fan)
    flat = normalised(F.col(text_col))
    entries = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_points"),
        flat.alias("_flat"),
    ).select(
        "doc_id",
        "n_points",
        F.unhex(F.sha2(F.col("_flat").cast("binary"), 256)).alias("digest"),
        F.octet_length("_flat").cast("long").alias("n_bytes"),
        F.xxhash64("_flat").alias("check"),
        # tells repeated rows apart; the table is written, so a later read sees the same numbers
        F.monotonically_increasing_id().alias("_row"),
    )
    entries = scratch.keep(entries, "entries").withColumn("address", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(fan**rounds)))
    rank = F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    level = entries.groupBy("address", *KEY).agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    levels = []
    for digit in range(rounds):
        level = scratch.keep(level, f"level-{digit}")
        routed = level.withColumn("up", _rerouted(digit, fan))
        levels.append(routed.select("address", "up", *KEY))
        level = (
            routed.groupBy(F.col("up").alias("address"), *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            .select("address", *KEY, "best", "n")
        )
    winners = scratch.keep(level, "winners")
    for digit in reversed(range(rounds)):
        found = levels[digit].join(winners.withColumnRenamed("address", "up"), ["up", *KEY])
        winners = scratch.keep(found.select("address", *KEY, "best", "n"), f"down-{digit}")
        scratch.drop(f"level-{digit}", f"down-{digit + 1}" if digit + 1 < rounds else "winners")
    return entries.join(winners, ["address", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best._row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the groups of equal texts of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents
), g as (
  select doc_id, text_sha256,
         first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
