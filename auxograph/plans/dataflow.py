"""Dataflows: functions over named results, put in sequence, side by side, and together.

A node takes the results so far (a dictionary of tables and values) and returns new ones. Tables are
lazy, so a dataflow only builds a plan; what no result needs is never computed. ``a >> b`` runs b
after a, ``a * b`` runs both on the same input, ``fork / renames`` joins the branches' results under
new names, ``fork >> c`` joins them as they are (later branches win).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any

Results = dict[str, Any]


class MissingArguments(ValueError):
    """A node needs results that nothing before it gives."""


class Node:
    """A step of a dataflow."""

    def run(self, results: Results) -> Results:
        raise NotImplementedError

    def __call__(self, **results: Any) -> Results:
        return self.run(dict(results))

    def __rshift__(self, other: Node) -> Sequence:
        return Sequence([*_steps(self), *_steps(other)])

    def __mul__(self, other: Node | int) -> Fork:
        if isinstance(other, int):
            if other < 1:
                raise ValueError("a node is repeated once at least")
            return Fork([self] * other)
        return Fork([*_branches(self), *_branches(other)])


class Step(Node):
    """A function whose parameters are names of results; it returns a dictionary of results.

    With ``gives`` the function's value is one result of that name.
    """

    def __init__(self, function: Callable[..., Any], gives: str | None = None):
        self.function, self.gives = function, gives
        self.parameters = inspect.signature(function).parameters

    def run(self, results: Results) -> Results:
        kinds = [p.kind for p in self.parameters.values()]
        if inspect.Parameter.VAR_KEYWORD in kinds:
            given = results
        else:
            given = {k: v for k, v in results.items() if k in self.parameters}
        missing = [n for n, p in self.parameters.items() if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL) and n not in given]
        if missing:
            raise MissingArguments(f"{self.function.__name__} needs {', '.join(missing)}; there are {', '.join(sorted(results)) or 'no results'}")
        value = self.function(**given)
        return {self.gives: value} if self.gives else dict(value or {})


class Identity(Node):
    """Gives no new results: all go through."""

    def run(self, results: Results) -> Results:
        return {}


class Sequence(Node):
    """Steps that each see what the ones before gave; a later result of the same name wins."""

    def __init__(self, steps: list[Node]):
        self.steps = list(steps)

    def run(self, results: Results) -> Results:
        given: Results = {}
        for step in self.steps:
            given |= step.run(results | given)
        return given


class Fork:
    """Branches that all start from the same results; they are lazy and so independent."""

    def __init__(self, branches: list[Node]):
        self.branches = list(branches)

    def __getitem__(self, i: int) -> Node:
        return self.branches[i]

    def __setitem__(self, i: int, node: Node) -> None:
        self.branches[i] = node

    def __len__(self) -> int:
        return len(self.branches)

    def __call__(self, **results: Any) -> tuple[Results, ...]:
        return tuple(b.run(dict(results)) for b in self.branches)

    def __mul__(self, other: Node | Fork) -> Fork:
        return Fork([*self.branches, *_branches(other)])

    def __truediv__(self, renames: list[Mapping[str, str] | None] | Mapping[int, Mapping[str, str]]) -> Join:
        return Join(self, renames)

    def __rshift__(self, other: Node) -> Sequence:
        return Join(self, {}) >> other


class Join(Node):
    """The results of all branches, renamed (per branch: old name to new); later branches win."""

    def __init__(self, fork: Fork, renames: list[Mapping[str, str] | None] | Mapping[int, Mapping[str, str]]):
        self.fork = fork
        self.renames = dict(enumerate(renames)) if isinstance(renames, list) else dict(renames)

    def run(self, results: Results) -> Results:
        given: Results = {}
        for i, branch in enumerate(self.fork.branches):
            names = self.renames.get(i) or {}
            given |= {names.get(k, k): v for k, v in branch.run(dict(results)).items()}
        return given


def _steps(node: Node | Fork) -> list[Node]:
    if isinstance(node, Fork):
        return [Join(node, {})]
    return node.steps if isinstance(node, Sequence) else [node]


def _branches(node: Node | Fork) -> list[Node]:
    return node.branches if isinstance(node, Fork) else [node]
