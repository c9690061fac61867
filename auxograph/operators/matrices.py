"""Matrices for metabolic models: fluxes, presence and bounds of exchange reactions.

A mapping is reference data of some hundred rows; its number of rows is checked, and it becomes a literal
in the plan. What an experiment supplies is then a map column of its own row, and its cells are one array
over the literal of all exchanges, of which every column of a matrix is a place: a matrix is a projection
of the growth table, without a join or a shuffle, and its plan has a fixed number of expressions besides
those places. ``flux_sparse`` keeps the cells that aren't 0 in a map, whatever the number of exchanges.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxograph.functions.growth import flux
from auxograph.functions.values import strip, suffix_removed
from auxograph.operators.mapping import FIXED, MEDIUM, SUPPLEMENT, supplement_tokens

#: Rows of reference data that may become a literal of a plan.
MOST_ROWS = 20_000
_SUPPLIED = "_supplied"
_CELLS = "_cells"


def reference_rows(df: DataFrame, what: str, most: int = MOST_ROWS) -> list[dict[str, Any]]:
    """The rows of a table of reference data, after a check that it is one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return [r.asDict() for r in rows]


def successful(growth: DataFrame, success: str = "success") -> DataFrame:
    """Rows of successful fits."""
    return growth.where(F.coalesce(F.col(success), F.lit(False))) if success in growth.columns else growth


def row_tokens(column: str, separator: str) -> Column:
    """The supplements of a row in their order, stripped and in lower case; none for null."""
    pattern = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in separator)
    parts = F.transform(F.split(F.col(column).cast("string"), pattern), lambda p: F.lower(strip(p)))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def _literal(value: Any, kind: str) -> Column:
    """A nested literal from one text, which is read once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lookup(entries: Mapping[str, Sequence[tuple]], fields: str) -> Callable[[Column], Column]:
    """From a text to an array of structs, by a literal; null for other texts.

    A map column is searched from its beginning, so the entries are dealt over small maps by checksum.
    """
    names = [f.split(":")[0].strip() for f in fields.split(",")]
    buckets: list[dict[str, list[dict]]] = [{} for _ in range(len(entries) // 4 + 1)]
    for key, values in entries.items():
        buckets[zlib.crc32(key.encode()) % len(buckets)][key] = [dict(zip(names, v)) for v in values]
    literal = _literal(buckets, f"array<map<string, array<struct<{fields}>>>>")
    return lambda text: F.try_element_at(F.get(literal, (F.crc32(text.cast("binary")) % len(buckets)).cast("int")), text)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _wide(rows: DataFrame, cells: Column, names: Sequence[str], last: str) -> DataFrame:
    """A column for each place of ``cells``, then the column ``last``."""
    made = rows.select(last, cells.alias(_CELLS))
    return made.selectExpr(*[f"get({_CELLS}, {i}) AS {_quoted(n)}" for i, n in enumerate(names)], _quoted(made.columns[0]))


def _smallest(rows: Sequence[dict[str, Any]], value: str) -> Any:
    """``value`` of the first row by (name, value), null first."""
    key = lambda r: (r["name"] is not None, r["name"] or "", r[value] is not None, r[value] or 0.0)
    return min(rows, key=key)[value] if rows else None


class Exchanges:
    """The active exchanges of a mapping: those with a row whose source is stated."""

    def __init__(self, mapping: DataFrame):
        stated = mapping.where(F.col("source").isin(SUPPLEMENT, MEDIUM, FIXED) & F.col("exchange_reaction").isNotNull())
        rows = reference_rows(stated.select("name", "iupac_name", "exchange_reaction", "mmol_concentration", "flux_upper_bound", "source"), "the mapping")
        self.rows: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for r in rows:
            self.rows[r["exchange_reaction"]][r["source"]].append(r)
        self.names = sorted(self.rows)

    def supplied(self, column: str, separator: str) -> Column:
        """Map column: concentration by exchange of what a row's supplements supply.

        A supplement is found by name or IUPAC name. Of several that supply an exchange, one found
        by its name comes first, then the first of the row, then the least concentration.
        """
        found: dict[str, list[tuple]] = defaultdict(list)
        for name in self.names:
            for r in self.rows[name].get(SUPPLEMENT, ()):
                for by, key in enumerate((r["name"], r["iupac_name"])):
                    if key:
                        found[key].append((by, r["mmol_concentration"], name))
        if not found:
            return F.create_map().cast("map<string, double>")
        lookup = _lookup(found, "by: int, mmol: double, exchange: string")

        def ranked(token: Column, place: Column) -> Column:
            hits = F.coalesce(lookup(token), F.array().cast("array<struct<by: int, mmol: double, exchange: string>>"))
            return F.transform(hits, lambda h: F.struct(h["by"].alias("by"), place.alias("place"), h["mmol"].alias("mmol"), h["exchange"].alias("exchange")))

        hits = F.array_sort(F.flatten(F.transform(row_tokens(column, separator), ranked)))
        # the first hit of each exchange: one whose place in the sorted list is that of its exchange
        order = F.transform(hits, lambda h: h["exchange"])
        first = F.filter(hits, lambda h, i: F.array_position(order, h["exchange"]) == i + 1)
        return F.map_from_entries(F.transform(first, lambda h: F.struct(h["exchange"], h["mmol"])))

    def _each(self, cell: Callable[[Column], Column]) -> Column:
        """An array: ``cell`` of every exchange, whose fields are exchange, by (its source) and its constant ``value``."""
        entries = []
        for name in self.names:
            of = self.rows[name]
            by = next(source for source in (SUPPLEMENT, MEDIUM, FIXED) if of.get(source))
            constant = None
            if by == MEDIUM:
                constant = _smallest(of[MEDIUM], "mmol_concentration")
            elif by == FIXED:
                constant = _smallest(of[FIXED], "flux_upper_bound") or 0.0
            entries.append({"exchange": name, "by": by, "value": None if constant is None else float(constant)})
        return F.transform(_literal(entries, "array<struct<exchange: string, by: string, value: double>>"), cell)

    def fluxes(self, max_time: str, of: Callable[[Column, Column], Column] = lambda exchange, value: value) -> Column:
        """Supplement before medium before fixed; what can be supplied and isn't, by this row, is 0."""

        def cell(e: Column) -> Column:
            # a hit without a concentration supplies nothing
            supplied = F.coalesce(flux(F.try_element_at(F.col(_SUPPLIED), e["exchange"]), max_time), F.lit(0.0))
            return of(e["exchange"], F.when(e["by"] == SUPPLEMENT, supplied).when(e["by"] == MEDIUM, flux(e["value"], max_time)).otherwise(e["value"]))

        return self._each(cell)

    def presences(self, of: Callable[[Column, Column], Column] = lambda exchange, value: value) -> Column:
        def cell(e: Column) -> Column:
            supplied = F.try_element_at(F.col(_SUPPLIED), e["exchange"]).isNotNull().cast("int")
            return of(e["exchange"], F.when(e["by"] == SUPPLEMENT, supplied).otherwise(F.lit(1)))

        return self._each(cell)

    def prepared(self, growth: DataFrame, success: str, column: str, separator: str) -> DataFrame:
        """The successful rows with the map of what they supply."""
        nothing = F.create_map().cast("map<string, double>")
        return successful(growth, success).withColumn(_SUPPLIED, self.supplied(column, separator) if column in growth.columns else nothing)


def exchange_list(mapping: DataFrame) -> list[str]:
    """The active exchanges in alphabetical order: the columns of a matrix."""
    return Exchanges(mapping).names


def _entry(exchange: Column, value: Column) -> Column:
    return F.struct(exchange.alias("exchange_reaction"), value.alias("value"))


def _kept(rows: DataFrame) -> list[str]:
    return [_quoted(c) for c in rows.columns if c != _SUPPLIED]


def flux_long(
    growth: DataFrame, mapping: DataFrame, success: str = "success", max_time: str = "max_time", column: str = "supplements", separator: str = ";"
) -> DataFrame:
    """(the row's columns, exchange_reaction, value): fluxes."""
    exchanges = Exchanges(mapping)
    rows = exchanges.prepared(growth, success, column, separator)
    return rows.select(*_kept(rows), F.inline(exchanges.fluxes(max_time, _entry)))


def flux_sparse(
    growth: DataFrame, mapping: DataFrame, success: str = "success", max_time: str = "max_time", column: str = "supplements", separator: str = ";"
) -> DataFrame:
    """(the row's columns, fluxes): a map from exchange to flux, without those that are 0 or null."""
    exchanges = Exchanges(mapping)
    rows = exchanges.prepared(growth, success, column, separator)
    cells = F.filter(exchanges.fluxes(max_time, _entry), lambda c: c["value"] != 0.0)
    return rows.select(*_kept(rows), F.map_from_entries(cells).alias("fluxes"))


def presence_long(growth: DataFrame, mapping: DataFrame, success: str = "success", column: str = "supplements", separator: str = ";") -> DataFrame:
    """(the row's columns, exchange_reaction, value): 1 where the exchange is available to the row."""
    exchanges = Exchanges(mapping)
    rows = exchanges.prepared(growth, success, column, separator)
    return rows.select(*_kept(rows), F.inline(exchanges.presences(_entry)))


def flux_matrix(
    growth: DataFrame,
    mapping: DataFrame,
    growth_rate: str = "mu_max",
    suffix: str | None = None,
    success: str = "success",
    max_time: str = "max_time",
    column: str = "supplements",
    separator: str = ";",
) -> DataFrame:
    """One row per successful experiment, in the order of ``growth``: the fluxes of the exchanges, then the growth rate."""
    exchanges = Exchanges(mapping)
    rows = exchanges.prepared(growth, success, column, separator)
    return _wide(rows, exchanges.fluxes(max_time), [f"{e}{suffix or ''}" for e in exchanges.names], growth_rate)


def presence_matrix(
    growth: DataFrame,
    mapping: DataFrame,
    growth_rate: str = "mu_max",
    suffix: str | None = None,
    success: str = "success",
    column: str = "supplements",
    separator: str = ";",
) -> DataFrame:
    """The same with 1 where an exchange is available to the experiment, else 0."""
    exchanges = Exchanges(mapping)
    rows = exchanges.prepared(growth, success, column, separator)
    return _wide(rows, exchanges.presences(), [f"{e}{suffix or ''}" for e in exchanges.names], growth_rate)


def bounds_matrix(
    presence: DataFrame,
    mapping: DataFrame,
    fluxes: DataFrame,
    growth_rate: str = "mu_max",
    default_level: int = 1,
    variable_level: int = 100,
    default_max: float = 1000,
    model_bounds: Mapping[str, tuple[int, int]] | DataFrame | None = None,
    custom_bounds: Mapping[str, tuple[int, int]] | None = None,
    suffix: str | None = None,
) -> DataFrame:
    """Three rows: level, max_value, ratio_drawing; one column per exchange of ``presence``.

    Custom bounds come first, then a positive largest flux or mapped bound, then the model's bounds,
    then the defaults. Of several mapped bounds of an exchange the last by (exchange, name) counts.
    The suffix is taken off at the end of a name only.
    """
    spark = presence.sparkSession
    if isinstance(model_bounds, DataFrame):
        model_bounds = {r["exchange_reaction"]: (r["level"], r["max_value"]) for r in reference_rows(model_bounds, "the model's bounds")}
    columns = [c for c in presence.columns if c != growth_rate]
    mapped = mapping.groupBy("exchange_reaction").agg(F.max_by("flux_upper_bound", "name").alias("bound"))
    bounds = {r["exchange_reaction"]: r["bound"] or 0.0 for r in reference_rows(mapped, "the mapping")}
    flux_columns = [c for c in fluxes.columns if c != growth_rate]
    if flux_columns:
        top = fluxes.selectExpr(*[f"max({_quoted(c)}) AS {_quoted(c)}" for c in flux_columns]).first()
        for c in flux_columns:
            if suffix_removed(c, suffix) in bounds and (top[c] or 0.0) > 0:
                bounds[suffix_removed(c, suffix)] = top[c]
    chosen: list[tuple[float, float]] = []
    for c in columns:
        plain = suffix_removed(c, suffix)
        if custom_bounds and c in custom_bounds:
            chosen.append(custom_bounds[c])
        elif bounds.get(plain, 0.0) > 0:
            chosen.append((variable_level, bounds[plain]))
        elif model_bounds and (c in model_bounds or plain in model_bounds):
            chosen.append(model_bounds[c] if c in model_bounds else model_bounds[plain])
        else:
            chosen.append((default_level, default_max))
    rows = [("level", *(float(x) for x, _ in chosen)), ("max_value", *(float(x) for _, x in chosen)), ("ratio_drawing", *(0.0 for _ in chosen))]
    return spark.createDataFrame(rows, "name string" + "".join(f", {_quoted(c)} double" for c in columns))


def supplement_matrix(growth: DataFrame, exchanges: DataFrame, baseline: list[str], column: str = "supplements", separator: str = ";", growth_rate: str = "mu_max") -> DataFrame:
    """0/1 matrix straight from (name, exchange_reaction); exchanges of ``baseline`` are always 1."""
    known = exchanges.where(F.col("exchange_reaction").isNotNull()).select("name", "exchange_reaction").distinct()
    rows = reference_rows(known, "the table of exchanges")
    of: dict[str, list[tuple]] = defaultdict(list)
    for r in rows:
        if r["name"]:
            of[r["name"]].append((r["exchange_reaction"],))
    names = sorted({*baseline, *(r["exchange_reaction"] for r in rows)})
    nothing = F.array().cast("array<struct<exchange: string>>")
    lookup = _lookup(of, "exchange: string")
    hits = F.flatten(F.transform(row_tokens(column, separator), lambda t: F.coalesce(lookup(t), nothing)))
    found = successful(growth).withColumn(_SUPPLIED, F.transform(hits, lambda h: h["exchange"]))
    always = _literal([{"exchange": n, "always": n in baseline} for n in names], "array<struct<exchange: string, always: boolean>>")
    cells = F.transform(always, lambda e: (e["always"] | F.array_contains(F.col(_SUPPLIED), e["exchange"])).cast("int"))
    return _wide(found, cells, names, growth_rate)


def mapping_audit(growth: DataFrame, exchanges: DataFrame, column: str = "supplements", separator: str = ";", cutoff: float = 0.6) -> DataFrame:
    """How each supplement is mapped: exact, fuzzy or unmapped."""
    from auxograph.operators.mapping import fuzzy_top

    tokens = supplement_tokens(growth, column, separator)
    matched = fuzzy_top(tokens, "token", exchanges, "name", cutoff)
    kind = F.when(F.col("match") == F.col("token"), "exact").when(F.col("match").isNotNull(), "fuzzy").otherwise("unmapped")
    return matched.withColumn("result", kind).join(exchanges.withColumnRenamed("name", "match"), "match", "left").select("token", "result", "match", "score", "exchange_reaction")


def bounds_precedence(exchanges: DataFrame, custom: DataFrame, mapped: DataFrame, model: DataFrame, default_level: int = 1, variable_level: int = 100, default_max: float = 1000.0) -> DataFrame:
    """The same precedence on long tables keyed by ``exchange_reaction``: custom, mapped (positive), model, default."""
    named = lambda df, p: df.select("exchange_reaction", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "exchange_reaction"])
    joined = exchanges
    for df, p in ((custom, "c"), (mapped, "m"), (model, "s")):
        joined = joined.join(named(df, p), "exchange_reaction", "left")
    positive = F.col("m_max_value") > 0
    return joined.select(
        "exchange_reaction",
        F.coalesce("c_level", F.when(positive, F.lit(variable_level)), "s_level", F.lit(default_level)).cast("int").alias("level"),
        F.coalesce("c_max_value", F.when(positive, F.col("m_max_value")), "s_max_value", F.lit(default_max)).cast("double").alias("max_value"),
    )
