"""Plans as nodes and edges, and their text, Mermaid and DOT forms."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from .frontend import Graph, call_target, with_kind


@dataclass
class Node:
    id: int
    op: str
    label: str
    group: str = ""


@dataclass
class Plan:
    nodes: list[Node]
    edges: list[tuple[int, int, str]]


def plan_of(graph: Graph) -> Plan:
    """One node a statement, in the opcodes input, calc, decide, switch, loop, parallel, call, error, merge and return."""
    nodes: list[Node] = []
    edges: list[tuple[int, int, str]] = []

    def node(op: str, label: str, before: list[tuple[int, str]], group: str) -> int:
        nodes.append(Node(len(nodes), op, label, group))
        edges.extend((b, len(nodes) - 1, c) for b, c in before)
        return len(nodes) - 1

    def walk(stmts: list[ast.stmt], before: list[tuple[int, str]], group: str) -> list[tuple[int, str]]:
        for s in stmts:
            text = ast.unparse(s).split("\n")[0]
            match s:
                case ast.If():
                    d = node("decide", ast.unparse(s.test), before, group)
                    ends = walk(s.body, [(d, "true")], group) + walk(s.orelse, [(d, "false")], group)
                    before = [(node("merge", "", ends, group), "")] if ends else []
                case ast.Match():
                    d = node("switch", ast.unparse(s.subject), before, group)
                    ends = [e for c in s.cases for e in walk(c.body, [(d, ast.unparse(c.pattern))], group)]
                    before = [(node("merge", "", ends, group), "")] if ends else []
                case ast.For():
                    d = node("loop", text.rstrip(":"), before, group)
                    edges.extend((b, d, "next") for b, _ in walk(s.body, [(d, "body")], group))
                    before = [(d, "done")]
                case ast.With() if with_kind(s) == "parallel":
                    d = node("parallel", "", before, group)
                    before = [(node("merge", "", [e for b in s.body for e in walk([b], [(d, "")], group)], group), "")]
                case ast.With():
                    before = walk(s.body, before, s.items[0].context_expr.args[0].value)
                case ast.Return():
                    node("return", ast.unparse(s.value) if s.value else "", before, group)
                    before = []
                case ast.Raise():
                    node("error", text, before, group)
                    before = []
                case ast.Pass():
                    pass
                case _:
                    op = "call" if any(isinstance(n, ast.Call) and call_target(n) for n in ast.walk(s)) else "calc"
                    before = [(node(op, text, before, group), "")]
        return before

    before = [(node("input", p, [], ""), "") for p in graph.params]
    walk(graph.body, before, "")
    return Plan(nodes, edges)


def view(plan: Plan, kind: str = "full") -> Plan:
    """full; summary, where groups are one node and plain calculations are passed through; layers, where nodes carry their depth."""
    if kind == "full":
        return plan
    if kind == "layers":
        depth = {n.id: 0 for n in plan.nodes}
        for a, b, c in plan.edges:
            if c != "next":
                depth[b] = max(depth[b], depth[a] + 1)
        return Plan([Node(n.id, n.op, n.label, f"layer {depth[n.id]}") for n in plan.nodes], plan.edges)
    groups: dict[str, int] = {}
    to: dict[int, int] = {}
    nodes: list[Node] = []
    for n in plan.nodes:
        if n.group:
            if n.group not in groups:
                groups[n.group] = n.id
                nodes.append(Node(n.id, "group", n.group))
            to[n.id] = groups[n.group]
        elif n.op in ("calc", "merge"):
            to[n.id] = -1
        else:
            to[n.id] = n.id
            nodes.append(n)
    after: dict[int, list[tuple[int, str]]] = {}
    for a, b, c in plan.edges:
        after.setdefault(a, []).append((b, c))

    def reach(i: int, seen: frozenset[int] = frozenset()) -> set[tuple[int, str]]:
        out = set()
        for b, c in after.get(i, []):
            if to[b] >= 0:
                out.add((to[b], c))
            elif b not in seen:
                out |= reach(b, seen | {b})
        return out

    edges = {(to[n.id], b, c) for n in plan.nodes if to[n.id] >= 0 for b, c in reach(n.id) if b != to[n.id]}
    return Plan(nodes, sorted(edges))


def text(plan: Plan) -> str:
    lines = [f"{n.id:>4}  {n.op:<9} {n.label}" + (f"  [{n.group}]" if n.group else "") for n in plan.nodes]
    return "\n".join([*lines, *(f"{a:>4} -> {b}" + (f"  ({c})" if c else "") for a, b, c in plan.edges)])


def _safe(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', "'")


def mermaid(plan: Plan, direction: str = "td") -> str:
    lines = [f"graph {direction.upper()}", *(f'  n{n.id}["{n.op}: {_safe(n.label)}"]' for n in plan.nodes)]
    return "\n".join([*lines, *(f"  n{a} -->|{_safe(c)}| n{b}" if c else f"  n{a} --> n{b}" for a, b, c in plan.edges)])


def dot(plan: Plan, direction: str = "td") -> str:
    lines = ["digraph plan {", f"  rankdir={'LR' if direction == 'lr' else 'TB'};", *(f'  n{n.id} [label="{n.op}: {_safe(n.label)}"];' for n in plan.nodes)]
    return "\n".join([*lines, *(f'  n{a} -> n{b} [label="{_safe(c)}"];' for a, b, c in plan.edges), "}"])
