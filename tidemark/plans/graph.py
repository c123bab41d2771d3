"""A registry of models: dependencies, selection of a node and what follows from it, and a build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    """A model: fn takes its inputs by name. kind: view, table, incremental or snapshot.

    merge: of an incremental, its key and the column by which a later row replaces an earlier one.
    """

    name: str
    inputs: tuple[str, ...]
    fn: Callable[..., DataFrame]
    kind: str = "table"
    merge: tuple[str, str] | None = None


@dataclass
class Graph:
    """Nodes by name; inputs that are no node are sources."""

    nodes: dict[str, Node] = field(default_factory=dict)

    def model(self, name: str, *inputs: str, kind: str = "table", merge: tuple[str, str] | None = None):
        """Register a function as a model."""

        def add(fn):
            self.nodes[name] = Node(name, inputs, fn, kind, merge)
            return fn

        return add

    def order(self) -> list[str]:
        """Every node after its inputs."""
        sorter = TopologicalSorter({n: [i for i in node.inputs if i in self.nodes] for n, node in self.nodes.items()})
        return list(sorter.static_order())

    def descendants(self, name: str) -> set[str]:
        """A node and all that depends on it."""
        out = {name}
        for n in self.order():
            if out & set(self.nodes[n].inputs):
                out.add(n)
        return out

    def select(self, select: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
        """Names in build order. "x" is a node, "x+" it and its descendants."""

        def expand(terms) -> set[str]:
            out: set[str] = set()
            for term in terms:
                name = term.rstrip("+")
                if name not in self.nodes:
                    raise KeyError(f"no model named {name}")
                out |= self.descendants(name) if term.endswith("+") else {name}
            return out

        chosen = expand(select) if select is not None else set(self.nodes)
        return [n for n in self.order() if n in chosen - expand(exclude)]

    def lineage(self) -> str:
        """The graph as a Mermaid diagram."""
        edges = [f"  {i.replace('.', '_')} --> {n}" for n in self.order() for i in self.nodes[n].inputs]
        return "\n".join(["graph LR", *edges])
