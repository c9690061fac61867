"""Compounds: a local table in place of an online service.

A resolver can be given where the table lacks a compound; without one nothing leaves the machine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from auxograph.functions.chemistry import COMPOUND_COLUMNS


@dataclass(frozen=True)
class Compound:
    name: str
    cid: int | None = None
    smiles: str | None = None
    iupac_name: str | None = None
    molecular_weight: float | None = None


def _key(kind: str, value) -> tuple:
    return kind, str(value).strip().lower().replace("-", " ") if kind == "name" else str(value)


@dataclass
class CompoundTable:
    """Lookups by name, id or SMILES; what a resolver found is remembered."""

    compounds: list[Compound] = field(default_factory=list)
    resolver: Callable[[str, object], Compound | None] | None = None

    def __post_init__(self):
        self._found: dict[tuple, Compound | None] = {}
        for c in self.compounds:
            for kind, value in (("name", c.name), ("name", c.iupac_name), ("cid", c.cid), ("smiles", c.smiles)):
                if value is not None:
                    self._found.setdefault(_key(kind, value), c)

    def find(self, kind: str, value) -> Compound | None:
        """``kind``: name, cid or smiles."""
        key = _key(kind, value)
        if key not in self._found and self.resolver is not None:
            self._found[key] = self.resolver(kind, value)
        return self._found.get(key)

    def weight(self, kind: str, value) -> float | None:
        found = self.find(kind, value)
        return found.molecular_weight if found else None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.cid, c.smiles, c.iupac_name, c.molecular_weight) for c in self.compounds], COMPOUND_COLUMNS)

    @classmethod
    def of(cls, df: DataFrame, resolver=None) -> CompoundTable:
        """From a table of COMPOUND_COLUMNS; such reference tables have some thousand rows at most."""
        return cls([Compound(**r.asDict()) for r in df.select("name", "cid", "smiles", "iupac_name", "molecular_weight").collect()], resolver)
