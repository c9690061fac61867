"""Literal tables of exchange reactions, and custom mappings from YAML."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Common supplements and their exchange reactions.
SUPPLEMENT_EXCHANGES = {
    "glucose": "EX_glc__D_e",
    "fructose": "EX_fru_e_i",
    "galactose": "EX_gal_e_i",
    "ribose": "EX_rib__D_e_i",
    "maltose": "EX_malt_e_i",
    "melibiose": "EX_melib_e_i",
    "trehalose": "EX_tre_e_i",
    "glycerol": "EX_glyc_e_i",
    "acetate": "EX_ac_e_i",
    "pyruvate": "EX_pyr_e_i",
    "succinate": "EX_succ_e_i",
    "lactate": "EX_lac__D_e_i",
    "d-lactate": "EX_lac__D_e_i",
    "alanine": "EX_ala__L_e_i",
    "l-alanine": "EX_ala__L_e_i",
    "proline": "EX_pro__L_e_i",
    "l-proline": "EX_pro__L_e_i",
    "threonine": "EX_thr__L_e_i",
    "l-threonine": "EX_thr__L_e_i",
    "glycine": "EX_gly_e_i",
    "adenine": "EX_ade_e",
    "uracil": "EX_ura_e",
    "guanine": "EX_gua_e",
    "cytosine": "EX_csn_e",
    "thymine": "EX_thymd_e",
}

# Exchange reactions that every minimal medium has.
MINIMAL_MEDIUM = (
    "EX_pi_e_i", "EX_co2_e_i", "EX_fe3_e_i", "EX_h_e_i", "EX_mn2_e_i", "EX_fe2_e_i", "EX_zn2_e_i", "EX_mg2_e_i",
    "EX_ca2_e_i", "EX_ni2_e_i", "EX_cu2_e_i", "EX_sel_e_i", "EX_cobalt2_e_i", "EX_h2o_e_i", "EX_mobd_e_i",
    "EX_so4_e_i", "EX_nh4_e_i", "EX_k_e_i", "EX_na1_e_i", "EX_cl_e_i", "EX_o2_e_i", "EX_tungs_e_i", "EX_slnt_e_i",
)

#: The mapping that comes with the package.
DEFAULT_MAPPING = os.path.join(os.path.dirname(__file__), "custom_mapping.yaml")


def supplement_exchanges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUPPLEMENT_EXCHANGES.items()), "name string, exchange_reaction string")


def minimal_medium(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in MINIMAL_MEDIUM], "exchange_reaction string")


def read_name_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """A static mapping table: name, iupac_name, exchange_reaction."""
    return spark.read.option("header", True).schema("name string, iupac_name string, exchange_reaction string").csv(path)


def load_custom_mapping(path: str | None = None) -> Mapping[str, Mapping[str, Any]]:
    """The entries under ``custom_mapping`` of a YAML file; of the package's own file by default."""
    import yaml

    with open(path or DEFAULT_MAPPING, encoding="utf-8") as f:
        return (yaml.safe_load(f) or {}).get("custom_mapping") or {}
