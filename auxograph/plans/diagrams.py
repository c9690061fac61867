"""Diagrams of YAML plans: Mermaid, Graphviz and HTML."""

from __future__ import annotations

import html
from typing import Any

from auxograph.plans.yaml_plans import _merged

STYLES = {"input": "#dbeafe", "process": "#fef3c7", "output": "#dcfce7"}


def structure(text: str) -> list[dict[str, Any]]:
    """The plans of a YAML text: name, nodes (id, kind, label) and edges (from, to)."""
    import yaml

    out = []
    for item in (yaml.safe_load(text) or {}).get("pipelines") or []:
        for name, plan in item.items():
            nodes, edges = [], []
            for k, v in (x for i in plan.get("Inputs") or [] for x in i.items()):
                nodes.append((k, "input", f"{k}: {_merged(v).get('method', '')}"))
            for k, v in (x for i in plan.get("Processes") or [] for x in i.items()):
                known = {n for n, _, _ in nodes}
                edges += [(p, k) for p in dict.fromkeys(p for p in (v.get("parameters") or {}).values() if isinstance(p, str) and p in known)]
                nodes.append((k, "process", f"{k}: {v.get('method', '')}"))
            for k, v in (x for i in plan.get("Outputs") or [] for x in i.items()):
                nodes.append((f"{k}_out", "output", ", ".join(v) if isinstance(v, list) else str(v)))
                edges.append((k, f"{k}_out"))
            out.append({"name": name, "nodes": nodes, "edges": edges})
    return out


def plan_names(text: str) -> list[str]:
    return [p["name"] for p in structure(text)]


def mermaid(plan: dict[str, Any]) -> str:
    shape = {"input": ("[(", ")]"), "process": ("[", "]"), "output": ("([", "])")}
    lines = ["graph TD"]
    lines += [f'  {i}{shape[kind][0]}"{label}"{shape[kind][1]}:::{kind}' for i, kind, label in plan["nodes"]]
    lines += [f"  {a} --> {b}" for a, b in plan["edges"]]
    lines += [f"  classDef {kind} fill:{colour}" for kind, colour in STYLES.items()]
    return "\n".join(lines)


def graphviz(plan: dict[str, Any]) -> str:
    shape = {"input": "cylinder", "process": "box", "output": "note"}
    lines = [f'digraph "{plan["name"]}" {{', "  rankdir=TB;"]
    lines += [f'  "{i}" [label="{label}", shape={shape[kind]}, style=filled, fillcolor="{STYLES[kind]}"];' for i, kind, label in plan["nodes"]]
    lines += [f'  "{a}" -> "{b}";' for a, b in plan["edges"]]
    return "\n".join([*lines, "}"])


def page(plans: list[dict[str, Any]]) -> str:
    """A page with each plan's Mermaid text, which also reads without a script."""
    parts = [f'<h2>{html.escape(p["name"])}</h2>\n<pre class="mermaid">\n{html.escape(mermaid(p))}\n</pre>' for p in plans]
    return "<!doctype html>\n<meta charset='utf-8'>\n<title>Plans</title>\n" + "\n".join(parts) + "\n"


FORMATS = {"mermaid": lambda ps: "\n\n".join(map(mermaid, ps)), "graphviz": lambda ps: "\n\n".join(map(graphviz, ps)), "html": page}


def diagram(text: str, fmt: str = "mermaid", name: str | None = None) -> str:
    """The diagram of one plan, or of all."""
    plans = [p for p in structure(text) if name in (None, p["name"])]
    if not plans:
        raise ValueError(f"no pipeline {name!r}" if name else "no pipelines")
    return FORMATS[fmt](plans)
