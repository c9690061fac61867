"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Rows get global numbers 0 .. N-1 in a total order (identifier, then content), a keyed Feistel
network permutes the numbers, and the permuted number p gives shard ``p % shards`` and slot
``p div shards``. Shards differ by at most one row, slots have no gaps, and place and number can be
computed from each other without a look at the data.

The network works on pairs (l, r) with l < a, r < b and a * b just above N (less than N + a), so a
permuted number falls outside 0 .. N-1 with a chance below 1 / sqrt(N); cycle walking then applies
the permutation again until it falls inside, which ends because the start lies inside the cycle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxograph.llm.shared import Scratch, prefix_sums, spread

#: A prime below 2 ** 31: products of two residues stay inside a long.
PRIME = 2_147_483_647
#: Keys of the rounds; an even number, so that both halves are changed equally often.
ROUND_KEYS = (1_540_483_477, 668_265_261, 374_761_393, 1_274_126_177, 951_274_213, 1_103_515_245)
#: Steps of a cycle walk; more are needed with a chance below N ** -15.
STEPS = 32


def halves(n: int) -> tuple[int, int]:
    """Sizes (a, b) of the two halves: a * b is at least n, and less than n + a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def _mixed(value: Column, key: Column, size: int) -> Column:
    """A keyed, nonlinear function of ``value`` with values below ``size``."""
    y = (value + key) % PRIME
    y = (y * y + key) % PRIME
    return (y * (key % 65_521 + 1) % PRIME) % size


def permuted(number: Column, n: int, keys: tuple[int, ...] = ROUND_KEYS) -> Column:
    """The Feistel permutation of 0 .. n-1, cycle walking included."""
    a, b = halves(n)
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("even"), F.lit(m).cast("long").alias("odd")) for k, m in zip(keys[::2], keys[1::2])])

    def round_pair(at: Column, key: Column) -> Column:
        left = F.struct(((at["l"] + _mixed(at["r"], key["even"], a)) % a).alias("l"), at["r"].alias("r"))
        # the new left half is needed twice; a one-element transform binds it
        return F.transform(
            F.array(left), lambda x: F.struct(x["l"].alias("l"), ((x["r"] + _mixed(x["l"], key["odd"], b)) % b).alias("r"))
        )[0]

    def once(x: Column) -> Column:
        start = F.struct((x % a).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        end = F.aggregate(pairs, start, round_pair)
        return F.transform(F.array(end), lambda e: e["r"] * a + e["l"])[0]

    steps = min(STEPS, a * b - n + 1)
    walk = F.sequence(F.lit(1), F.lit(steps))
    out = F.aggregate(walk, once(number), lambda at, _: F.when(at < n, at).otherwise(once(at)))
    return F.transform(F.array(out), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("long")))[0]


def shards(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys: tuple[int, ...] = ROUND_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard.

    The law is ``rows``: shard sizes in rows differ by at most one. ``size`` is the text's UTF-8
    bytes plus 1; a null text counts as empty. Rows are numbered by identifier (null last), then
    crc32 and size; rows equal in all three are interchangeable. An empty table gives an empty
    result; with fewer rows than shards some shards are empty. Other columns are not read.

    A number that has not come back inside after ``STEPS`` steps of its cycle walk is an error; a step
    leaves it outside with a chance below N ** -0.5, so that does not happen to any table of some
    hundred rows or more, and smaller ones have as many steps as there are numbers outside.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = scratch.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "slim",
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    # the ranges are written with their numbers: bounds come from a sample, but the order of the
    # rows over all ranges, and so the numbering, does not depend on them
    ranged = scratch.keep(
        slim.repartitionByRange(spread(spark), *order).select("*", F.spark_partition_id().alias("_part"), F.lit(1).alias("_one")),
        "ranged",
    )
    n = ranged.count()
    numbered = prefix_sums(ranged, [], "_part", order, "_one", "row_number")
    place = permuted(F.col("row_number"), n, keys)
    return numbered.withColumn("_place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "row_number",
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(n_shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: ``documents`` in shards 0 to 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql() -> str:
    """The same in SQL: a CRC table and a reduction over bytes, the network as nested selects, the walk as a recursion."""
    table = "".join(f", s{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from s{k})" for k in range(8))

    def mixed(value: str, key: int, size: str) -> str:
        y = f"(({value} + {key}) % {PRIME})"
        y = f"(({y} * {y} + {key}) % {PRIME})"
        return f"(({y} * {key % 65_521 + 1}) % {PRIME}) % {size}"

    once = "select n, a, b, row_number, place % a as l, place // a as r, steps from walk where place >= n or steps = 0"
    for even, odd in zip(ROUND_KEYS[::2], ROUND_KEYS[1::2]):
        once = f"select n, a, b, row_number, (l + {mixed('r', even, 'a')}) % a as l, r, steps from ({once})"
        once = f"select n, a, b, row_number, l, (r + {mixed('l', odd, 'b')}) % b as r, steps from ({once})"
    return f"""
with recursive s0 as (
  select range as i, range::bigint as c from range(0, 256)
){table}, t as (
  select list(c order by i) as t from s8
), d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
                         lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32
  from documents, t
), numbered as (
  select *, row_number() over (order by doc_id nulls last, text_crc32, size) - 1 as row_number, count(*) over () as n from d
), sized as (
  select n, a, greatest(1, (n + a - 1) // a) as b
  from (select any_value(n) as n, case when any_value(n) > 1 then floor(sqrt(any_value(n) - 1))::bigint + 1 else 1 end as a from numbered)
), walk as (
  select sized.n, a, b, row_number, row_number as place, 0 as steps from numbered, sized
  union all
  select n, a, b, row_number, r * a + l as place, steps + 1 as steps from ({once})
)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (place % 8)::int as shard, (place // 8)::bigint as slot, null::int as grown_shard
from numbered join (select row_number, place from walk where place < n and steps > 0) using (row_number)
"""


SQL = _sql()
