"""The sources and operators that a YAML plan can name.

A plan names a package and a method; only registered methods can be called, never an arbitrary import.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from auxograph.functions.tables import table_function
from auxograph.operators import gompertz, joins, mapping, matrices, plates, series, sinks
from auxograph.sources import experiments, plate_export, protocol, sbml, tables


@dataclass(frozen=True)
class Operator:
    """``function``; ``takes_session``: its first argument is the session; ``names``: parameters under other names."""

    function: Callable
    takes_session: bool = False
    names: tuple[tuple[str, str], ...] = ()

    def call(self, spark: SparkSession, arguments: dict):
        renamed = {dict(self.names).get(k, k): v for k, v in arguments.items()}
        return self.function(spark, **renamed) if self.takes_session else self.function(**renamed)

    def parameters(self) -> set[str]:
        import inspect

        own = set(inspect.signature(self.function).parameters)
        return own | {a for a, b in self.names if b in own}


def _names(**names: str) -> tuple[tuple[str, str], ...]:
    return tuple(names.items())


_SERIES = {"time_col": "time", "value_col": "value", "group_cols": "keys", "OD_0_col": "baseline", "value_is_log_transformed": "log_transformed"}
_MATRIX = {"growth_rates_df": "growth", "mappings_df": "mapping", "growth_rate_column": "growth_rate", "success_column": "success", "supplement_column": "column", "exchange_suffix": "suffix", "max_time_column": "max_time"}


def _predict(df, params_df, save_plot_data=False, output_dir=None, standard_deviation_column=None, **options):
    """Prediction; with ``save_plot_data`` a plot of each fitted series goes to the folder ``plots`` of ``output_dir``."""
    done = gompertz.predict_gompertz(df, params_df, **options)
    if save_plot_data:
        named = dict(zip(("time", "value", "keys", "fitted"), ("time_h", "log_od_od0", ("well",), "od600_fit"))) | options
        spread = standard_deviation_column if standard_deviation_column in done.columns else None
        fitted = done.where(done[named["fitted"]].isNotNull())
        plots = sinks.svg_plots(fitted, list(named["keys"]), named["time"], named["value"], named["fitted"], spread)
        sinks.save_plots(plots, os.path.join(output_dir or ".", "plots"))
    return done


def _build_mappings(growth_rates_df, supplement_to_exchange_map, custom_mapping_file=None, custom_mapping=None, fuzzy_threshold=0.6, halt_on_error=False, verbose=False, **options):
    return mapping.build_mappings(
        growth_rates_df, supplement_to_exchange_map, custom_file=custom_mapping_file, custom=custom_mapping, cutoff=fuzzy_threshold, strict=halt_on_error, **options
    )


def _collate(spark, folders_list, csv_input_file_name, strain_col="strain", create_output_folder=True, output_dir=None, groupby_pattern=None, csv_output_file_name="report.csv"):
    return sinks.collate_by_group(spark, folders_list, csv_input_file_name, strain_col, groupby_pattern, output_dir, create_output_folder, csv_output_file_name)


SOURCES: dict[str, Operator] = {
    "parse_raw_CLARIOstar_export": Operator(plate_export.read_plate, True, _names(value_column_name="value")),
    "parse_protocol_metadata": Operator(protocol.read_protocol, True),
    "parse_experiments": Operator(experiments.parsed_experiments, True, _names(value_column_name="value")),
    "read_csv": Operator(tables.read_csv, True),
    "list_folders": Operator(tables.list_folders),
    "load_file_mapping": Operator(tables.load_mapping),
    "parse_sbml_exchanges": Operator(sbml.read_exchanges, True),
    "parse_sbml_exchange_bounds": Operator(sbml.read_bounds, True),
}

OPERATORS: dict[str, Operator] = {
    "parse": Operator(plates.parse, names=_names(raw_data="readings", meta_data="protocol", value_column_name="value")),
    "report": Operator(plates.report, names=_names(raw_data="readings", meta_data="protocol", value_column_name="value")),
    "calculate_replicate_statistics_by_well": Operator(plates.replicates_by_well, names=_names(df_parsed="df", value_column_name="value")),
    "calculate_replicate_statistics_by_custom": Operator(plates.replicates_by_rules, names=_names(df_parsed="df", custom_rules="rules", value_column_name="value")),
    "transform_to_log_n_n0": Operator(series.log_ratio, names=_names(transformed_col="out", OD_0_averaging_window="window", **_SERIES)),
    "fit_max_growth_rate_per_series": Operator(
        series.max_growth_rate, names=_names(moving_window_size="window", smoothing_iterations="smoothing", smooth_window_size="half", **_SERIES)
    ),
    "fit_modified_gompertz_per_series": Operator(gompertz.fit_gompertz, names=_names(fixed_params="fixed", **_SERIES)),
    "predict_modified_gompertz_per_series": Operator(_predict, names=_names(**_SERIES)),
    "smart_join": Operator(joins.smart_join, names=_names(left_df="left", right_df="right", on_cols="on")),
    "smart_join_drop_right": Operator(joins.smart_join_drop_right, names=_names(left_df="left", right_df="right", on_cols="on")),
    "collate_by_strain": Operator(_collate, True),
    "table_function": Operator(table_function),
    "build_mappings": Operator(_build_mappings),
    "build_supplement_flux_dataframe": Operator(matrices.flux_matrix, names=_names(**_MATRIX)),
    "build_AMN_inputs_dataframe": Operator(matrices.presence_matrix, names=_names(**_MATRIX)),
    "build_AMN_levels_dataframe": Operator(
        matrices.bounds_matrix,
        names=_names(exchange_matrix="presence", flux_df="fluxes", default_variable_level="variable_level", default_max_value="default_max", sbml_bounds="model_bounds", **_MATRIX),
    ),
}


def register(name: str, function: Callable, takes_session: bool = False, source: bool = False) -> None:
    """Make a function known to plans."""
    (SOURCES if source else OPERATORS)[name] = Operator(function, takes_session)
