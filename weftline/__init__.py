"""Graphs of restricted Python as DataFrame transforms: a variable is a column, an execution is a row."""

from .plans.frontend import Graph, GraphError, check, compile_graph
from .plans.lower import apply_graph

__all__ = ["Graph", "GraphError", "apply_graph", "check", "compile_graph"]
