"""Plans in YAML: named inputs, processes over them, and output files.

::

    pipelines:
      - name:
          Inputs:    [{table: [{src: file}, {package: p}, {method: m}, {is_cached: true}, {option: value}]}]
          Processes: [{result: {package: p, method: m, parameters: {argument: result or value}}}]
          Outputs:   [{result: file.csv}]

A parameter whose text is the name of an input or of an earlier process is a reference, anything else is
a value. Building checks methods, arguments and references before anything runs, and a reference to
a later process is an error. Inputs and processes are lazy; a table that several later ones use, or
that is marked ``is_cached``, is persisted while the outputs are written. An output path that ends in a
slash is a folder, written by all tasks.
"""

from __future__ import annotations

import copy
import os
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from auxograph.operators.sinks import write_output
from auxograph.plans.actions import run_actions
from auxograph.plans.registry import OPERATORS, SOURCES

SHIPPED = os.path.join(os.path.dirname(__file__), "shipped")


class PlanError(ValueError):
    """A plan that can't be built."""


@dataclass
class Plan:
    name: str
    inputs: dict[str, dict[str, Any]]
    processes: dict[str, dict[str, Any]]
    outputs: dict[str, str | list[str]]
    output_dir: str | None = None
    references: dict[str, list[str]] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)

    def evaluate(self, spark: SparkSession) -> dict[str, Any]:
        """All results, as lazy tables and values; nothing is written but plots that a process asks for."""
        results: dict[str, Any] = {}
        used = Counter(r for of in self.references.values() for r in of)
        for name, spec in self.inputs.items():
            options = {k: v for k, v in spec.items() if k not in ("src", "package", "method", "is_cached")}
            operator = SOURCES[spec["method"]]
            function = operator.function
            renamed = {dict(operator.names).get(k, k): v for k, v in options.items()}
            results[name] = function(spark, spec["src"], **renamed) if operator.takes_session else function(spec["src"], **renamed)
            self._persist(results[name], spec.get("is_cached"), used[name])
        for name, spec in self.processes.items():
            arguments = {k: results[v] if isinstance(v, str) and v in results else v for k, v in (spec["parameters"] or {}).items()}
            operator = OPERATORS[spec["method"]]
            if self.output_dir is not None and "output_dir" in operator.parameters():
                arguments.setdefault("output_dir", self.output_dir)
            results[name] = operator.call(spark, arguments)
            self._persist(results[name], spec.get("is_cached"), used[name])
        return results

    def _persist(self, value: Any, asked: Any, uses: int) -> None:
        if isinstance(value, DataFrame) and (asked or uses > 1):
            self.persisted.append(value.persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        """Free what ``evaluate`` has persisted; the results stay valid and are computed anew."""
        while self.persisted:
            self.persisted.pop().unpersist()

    def run(self, spark: SparkSession, at_once: int = 1) -> dict[str, Any]:
        """Evaluate and write the outputs, ``at_once`` at a time; results that the plan doesn't have are skipped.

        An output that fails stops none of the others; all failures are raised together at the end.
        """
        try:
            results = self.evaluate(spark)
            done = run_actions(spark, {name: partial(write_output, results.get(name), path) for name, path in self.outputs.items()}, at_once)
        finally:
            self.release()
        if wrong := {name: o.error for name, o in done.items() if o.error}:
            if len(wrong) == 1:
                raise next(iter(wrong.values()))
            raise ExceptionGroup(f"plan {self.name!r}: outputs {', '.join(wrong)} failed", list(wrong.values()))
        return results


def _merged(items: Any) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for item in items if isinstance(items, list) else [items]:
        out |= item
    return out


def build(
    text: str,
    name: str,
    output_dir: str | None = None,
    sources: Mapping[str, str] | None = None,
    arguments: Mapping[str, Mapping[str, Any]] | None = None,
) -> Plan:
    """Build the plan ``name`` of a YAML text.

    ``sources``: input name to path, in place of ``src``; ``arguments``: process name to parameters that
    replace those of the plan; ``output_dir``: where the outputs go.
    """
    import yaml

    config = yaml.safe_load(text) or {}
    if "pipelines" not in config:
        raise PlanError("the YAML has no 'pipelines'")
    found = [d[name] for d in config["pipelines"] if name in d]
    if not found:
        raise PlanError(f"no pipeline {name!r}; there are {', '.join(n for d in config['pipelines'] for n in d)}")
    plan = copy.deepcopy(found[0])
    for section in ("Inputs", "Processes", "Outputs"):
        if section not in plan:
            raise PlanError(f"pipeline {name!r} has no {section}")
    inputs = {k: _merged(v) for item in plan["Inputs"] or [] for k, v in item.items()}
    for key, spec in inputs.items():
        if sources and key in sources:
            spec["src"] = sources[key]
        _check(f"input {key!r}", spec, ("src", "package", "method"), SOURCES)
    known, references, processes = set(inputs), {}, {}
    all_names = [k for item in plan["Processes"] or [] for k in item]
    for item in plan["Processes"] or []:
        for key, spec in item.items():
            _check(f"process {key!r}", spec, ("package", "method", "parameters"), OPERATORS)
            spec["parameters"] = dict(spec["parameters"] or {}) | dict((arguments or {}).get(key, {}))
            texts = [v for v in spec["parameters"].values() if isinstance(v, str)]
            references[key] = [v for v in texts if v in known]
            if late := [v for v in texts if v in all_names and v not in known and v != key]:
                raise PlanError(f"process {key!r} refers to {', '.join(late)}, which comes later")
            processes[key] = spec
            known.add(key)
    outputs = _merged(plan["Outputs"] or [{}])
    if output_dir is not None:
        outputs = {k: [os.path.join(output_dir, x) for x in v] if isinstance(v, list) else os.path.join(output_dir, v) for k, v in outputs.items()}
    return Plan(name, inputs, processes, outputs, output_dir, references)


def _check(what: str, spec: Any, fields: tuple[str, ...], methods: Mapping[str, Any]) -> None:
    missing = [f for f in fields if not isinstance(spec, dict) or f not in spec]
    if missing:
        raise PlanError(f"{what} has no {', '.join(missing)}")
    if spec["method"] not in methods:
        raise PlanError(f"{what}: method {spec['method']!r} is not registered")
    unknown = set(spec.get("parameters") or {}) - methods[spec["method"]].parameters()
    takes_any = "options" in methods[spec["method"]].parameters()
    names = {a for a, _ in methods[spec["method"]].names}
    if unknown - names and not takes_any:
        raise PlanError(f"{what}: {spec['method']} takes no {', '.join(sorted(unknown))}")


def build_file(path: str, name: str, **options: Any) -> Plan:
    with open(path, encoding="utf-8") as f:
        return build(f.read(), name, **options)


def build_shipped(file: str, name: str, **options: Any) -> Plan:
    """A plan of a file that comes with the package."""
    return build_file(os.path.join(SHIPPED, file), name, **options)


def run_batch(spark: SparkSession, text: str, name: str, runs: Mapping[str, Mapping[str, str]], output_dir: str, at_once: int = 1) -> dict[str, str]:
    """Run a plan for several sets of sources, each into its own folder, ``at_once`` at a time: run name to "ok" or the error.

    A run that fails does not stop the others.
    """

    def one(key: str, sources: Mapping[str, str]) -> None:
        folder = os.path.join(output_dir, key)
        os.makedirs(folder, exist_ok=True)
        build(text, name, folder, sources).run(spark)

    done = run_actions(spark, {key: partial(one, key, sources) for key, sources in runs.items()}, at_once)
    return {key: f"{type(o.error).__name__}: {o.error}" if o.error else "ok" for key, o in done.items()}
