"""Tables and mapping files: CSV, YAML and literal dictionaries; folders and pairs of files."""

from __future__ import annotations

import ast
import csv
import glob
import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_folders(spark: SparkSession, folders: Sequence[str], name: str, skip: str | None = None) -> DataFrame:
    """The file ``name`` of each folder, with the folder's name as ``experiment``; ``skip`` is left out.

    Files are read with one schema each and put together by column name.
    """
    kept = [f for f in folders if skip is None or os.path.abspath(f) != os.path.abspath(skip)]
    if not kept:
        raise ValueError("no folder to read from")
    out = None
    for folder in kept:
        df = read_csv(spark, os.path.join(folder, name)).withColumn("experiment", F.lit(os.path.basename(os.path.normpath(folder))))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def list_folders(path: str) -> list[str]:
    """The folders in ``path``, sorted."""
    if not os.path.isdir(path):
        raise ValueError(f"not a folder: {path}")
    return sorted(e.path for e in os.scandir(path) if e.is_dir())


def load_mapping(path: str) -> dict:
    """A dictionary from a file: two-column CSV, YAML, or a Python literal (never executed).

    A ``.py`` file may assign the literal to ``file_pars``, ``file_mapping`` or ``mapping``.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(f"no mapping file {path}")
    kind = os.path.splitext(path)[1].lower()
    with open(path, encoding="utf-8", newline="") as f:
        text = f.read()
    if kind == ".csv":
        head, *rows = csv.reader(text.splitlines())
        if len(head) != 2:
            raise ValueError(f"{path} must have two columns")
        return {r[0]: r[1] for r in rows if r}
    if kind in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = _literal(text, path, kind == ".py")
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a dictionary")
    return found


def _literal(text: str, path: str, is_module: bool):
    try:
        for node in ast.parse(text).body if is_module else ():
            names = {t.id for t in node.targets if isinstance(t, ast.Name)} if isinstance(node, ast.Assign) else set()
            if names & {"file_pars", "file_mapping", "mapping"}:
                return ast.literal_eval(node.value)
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError) as error:
        raise ValueError(f"{path} does not hold a literal: {error}") from error


def pair_files(folder: str, raw_pattern: str, protocol_pattern: str) -> dict[str, str]:
    """Raw file to protocol file: the n-th of each pattern in sorted order. Files without a partner are left out."""
    raw, protocol = (sorted(glob.glob(os.path.join(folder, p))) for p in (raw_pattern, protocol_pattern))
    for found, pattern in ((raw, raw_pattern), (protocol, protocol_pattern)):
        if not found:
            raise ValueError(f"no file matches {pattern} in {folder}")
    if len(raw) != len(protocol):
        log.warning("%d raw files and %d protocol files: the last ones have no partner", len(raw), len(protocol))
    return {os.path.basename(r): os.path.basename(p) for r, p in zip(raw, protocol)}
