"""Graphs in levels: members of a level are of one kind and read earlier levels only.

A map of labels says which are cut into blocks (they make up the grid of work) and which
stay whole.  When a graph runs, staged inputs are dealt to tasks by the labels that are cut,
to as many tasks as there are blocks at most; contractions that keep those labels then work
within their tasks and shuffle nothing.  Combinations of several members join them, which Spark
does without a shuffle if ``spark.sql.requireAllClusterKeysForCoPartition`` is false.  Levels
are validated whenever one is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from modeloom.plans.graph import Dag, Node, Output, Run


@dataclass(frozen=True)
class LabelTile:
    """A label that is cut into blocks of ``size``."""

    label: str
    size: int


@dataclass(frozen=True)
class LabelWhole:
    """A label that is not cut; its extent may not exceed ``size``."""

    label: str
    size: int


class LabelTiles:
    """The map of labels."""

    def __init__(self, *tiles: LabelTile | LabelWhole):
        names = [t.label for t in tiles]
        if len(set(names)) < len(names):
            raise ValueError(f"a label occurs twice in {names}")
        if bad := [t.label for t in tiles if t.size < 1]:
            raise ValueError(f"blocks of labels {bad} are empty")
        self.tiles = {t.label: t for t in tiles}

    def sizes(self, labels: Sequence[str]) -> dict[str, int]:
        """Block size of each label; raises for a label that is not in the map."""
        if missing := [x for x in labels if x not in self.tiles]:
            raise ValueError(f"labels {missing} are not in the map")
        return {x: self.tiles[x].size for x in labels}

    def grid(self, extents: dict[str, int]) -> dict[str, int]:
        """Blocks along each label that is cut and that the extents have."""
        for x, n in extents.items():
            t = self.tiles.get(x)
            if isinstance(t, LabelWhole) and n is not None and n > t.size:
                raise ValueError(f"whole label {x!r} has extent {n}, more than {t.size}")
        return {x: -(-n // self.tiles[x].size) for x, n in extents.items() if n is not None and isinstance(self.tiles.get(x), LabelTile)}


@dataclass(frozen=True)
class LevelGraph:
    """Levels over a map of labels; immutable."""

    tiles: LabelTiles
    dag: Dag = Dag()
    levels: tuple[tuple[int, ...], ...] = ()

    def add(self, *members: Node):
        """The graph with one more level, and a handle for each output of its members."""
        validate_level(members)
        for m in members:
            self.tiles.sizes(m.modes)
        dag, handles, places = self.dag, [], []
        before = sum(n.outputs for n in dag.nodes)
        for m in members:
            if late := [s for s in _reads(m) if s >= before]:
                raise ValueError(f"a member reads slots {late}, which its own level or a later one makes")
        for m in members:
            places.append(len(dag.nodes))
            dag, *made = dag.add(m)
            handles += made
        for m in members:
            if m.kind == "stage":
                self.tiles.grid(m.extents)
        return (replace(self, dag=dag, levels=(*self.levels, tuple(places))), *handles)

    def grid(self) -> dict[str, int]:
        """Blocks along the labels that are cut and that a staged input carries."""
        out: dict[str, int] = {}
        for n in self.dag.nodes:
            if n.kind == "stage":
                out |= self.tiles.grid(n.extents)
        return out

    def work_items(self) -> int:
        n = 1
        for b in self.grid().values():
            n *= b
        return n

    def outputs(self, *handles: Output) -> LevelGraph:
        return replace(self, dag=self.dag.outputs(*handles))

    def tasks(self, n: int) -> LevelGraph:
        """How many tasks staged inputs are dealt to (default: blocks of the grid, the session's number of shuffle partitions at most)."""
        return replace(self, dag=self.dag.tasks(n))

    def execute(self, persist: bool = True, release: bool = False) -> Run:
        """As :meth:`Dag.execute`, staged inputs dealt by the labels that are cut."""
        dag, by = self.dag, {}
        for k, n in enumerate(dag.nodes):
            cut = [m for m in n.modes if n.kind == "stage" and isinstance(self.tiles.tiles.get(m), LabelTile)]
            if cut:
                by[k] = cut
        if by and dag.width is None:
            session = _session(dag.nodes[next(iter(by))])
            dag = dag.tasks(max(1, min(self.work_items(), int(session.conf.get("spark.sql.shuffle.partitions")))))
        return dag.execute(persist, release, by)

    def execute_local(self, names: Sequence[str], dealt: bool = False) -> DataFrame:
        """The roots as one DataFrame with a column for each, from one shuffle by the one label that is cut; see :func:`modeloom.plans.local.execute_local`."""
        from modeloom.plans.local import execute_local

        cut = [m for m, t in self.tiles.tiles.items() if isinstance(t, LabelTile)]
        if len(cut) != 1:
            raise ValueError("a graph is local to one label that is cut")
        return execute_local(self.dag, cut[0], names, dealt)


def _session(node: Node):
    """The session of a staged input."""
    return node.operands[0].run().df.sparkSession if node.operands[0].kind == "input" else _session(node.operands[0])


def _reads(node: Node) -> set[int]:
    from modeloom.plans.graph import _slots_of

    return _slots_of(node)


def validate_level(members: Sequence[Node]) -> None:
    """One kind of member, one iteration space, at least one member."""
    if not members:
        raise ValueError("a level is empty")
    kinds = {m.kind for m in members}
    if not kinds <= {"stage", "contraction", "combine"}:
        raise ValueError(f"members of a level are stages, contractions or combines, not {sorted(kinds)}")
    if len(kinds) > 1:
        raise ValueError(f"a level mixes {sorted(kinds)}")
    if kinds == {"stage"}:
        return
    spaces = {frozenset(m.modes) for m in members}
    sizes = {m: {n.extents.get(m) for n in members if m in n.modes} - {None} for s in spaces for m in s}
    volume = {tuple(sorted(str(m.extents[x]) for x in m.modes)) for m in members}
    if len(volume) > 1 or any(len(v) > 1 for v in sizes.values()):
        raise ValueError("members of a level differ in their iteration space")
