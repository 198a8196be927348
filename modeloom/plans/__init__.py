"""Graphs of operations: trees, graphs with shared results, and levels."""

from modeloom.plans.graph import Dag, Graph, combination, contraction, input_node, kept, slot, stage
from modeloom.plans.levels import LabelTile, LabelTiles, LabelWhole, LevelGraph
from modeloom.plans.marginals import marginals
from modeloom.plans.timing import Timings

__all__ = ["Dag", "Graph", "LabelTile", "LabelTiles", "LabelWhole", "LevelGraph", "Timings", "combination", "contraction", "input_node", "kept", "marginals", "slot", "stage"]
