"""Expression nodes, and two ways to run them.

A node describes an operation on nodes; nothing runs until a graph is executed, and then
only as lazy DataFrames.  A :class:`Graph` evaluates trees; a :class:`Dag` names results that
several nodes read, makes each once, and keeps it from its first to its last reader.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from modeloom.labels import distinct, merge_extents, plan_contraction
from modeloom.operators.blocked import Blocked, contract_blocked
from modeloom.operators.combine import combine_multi
from modeloom.operators.contract import contract
from modeloom.operators.hooks import Hook, apply_hook, arity
from modeloom.tensor import Tensor


@dataclass(frozen=True)
class Node:
    """Labels and extents of a result, what makes it, and from what."""

    kind: str
    modes: tuple[str, ...]
    extents: dict
    operands: tuple = ()
    run: Callable | None = None
    outputs: int = 1
    slot: int | None = None
    finish: Callable | None = None
    fn: Callable | None = None
    weights: tuple = ()
    source: Tensor | None = None

    def as_(self, *labels: str) -> Node:
        """The node under other labels, by position."""
        if len(labels) != len(self.modes):
            raise ValueError(f"{len(labels)} labels for a node of rank {len(self.modes)}")
        distinct(labels, "relabel")
        return Node("relabel", labels, dict(zip(labels, self.extents.values())), (self,), lambda t: t.as_(*labels))


def input_node(tensor: Tensor, hook: Hook | None = None) -> Node:
    """A leaf; the hook is applied to each element that is read."""
    if hook is not None:
        arity(hook, tensor.rank + 1, "hook")
    return Node("input", tensor.modes, tensor.extents, (), lambda: apply_hook(tensor, hook), fn=hook, source=tensor)


def stage(tensor: Tensor | Node) -> Node:
    """A leaf that a graph with shared results keeps while it runs; otherwise the tensor as it is."""
    node = tensor if isinstance(tensor, Node) else input_node(tensor)
    return Node("stage", node.modes, node.extents, (node,), lambda t: t)


def slot(number: int, modes: Sequence[str], extents: dict | None = None) -> Node:
    """A result that another node of the graph owns, under labels of its own."""
    modes = distinct(modes, "slot")
    return Node("slot", modes, {m: (extents or {}).get(m) for m in modes}, slot=number)


def contraction(a: Node, b: Node, out: Sequence[str] | None = None, hook: Hook | None = None, value: str | None = None) -> Node:
    """Sum of products over the labels of both operands; ``value`` is a type that the result is cast to."""
    plan = plan_contraction(a.modes, b.modes, out)
    extents = merge_extents(a.extents, b.extents)
    if hook is not None:
        arity(hook, len(plan.out) + 1, "hook")

    def finish(t: Tensor) -> Tensor:
        return apply_hook(t.cast(value) if value else t, hook)

    return Node("contraction", plan.out, {m: extents[m] for m in plan.out}, (a, b), lambda x, y: finish(contract(x, y, plan.out)), finish=finish, fn=hook)


def combination(operands: Sequence[Node], fn: Callable, out: Sequence[str] | None = None, outputs: int = 1, join: str | None = None, weights: Sequence[Tensor] = (), value: str | None = None) -> Node:
    """A pointwise function of operands over one set of labels; ``outputs`` columns if more than one."""
    operands = tuple(operands)
    if not operands:
        raise ValueError("a combine needs an operand")
    out = distinct(operands[0].modes if out is None else out, "output")
    for n in operands:
        if set(n.modes) != set(out):
            raise ValueError(f"combine operand has labels {n.modes}, the output {out}")
    extents = merge_extents(*[n.extents for n in operands])
    arity(fn, len(out) + len(operands) + len(weights), "combine function")

    def run(*tensors: Tensor):
        made = combine_multi(out, tensors, fn if outputs > 1 else lambda *a: [fn(*a)], join, weights)
        if len(made) != outputs:
            raise ValueError(f"the function gave {len(made)} columns, {outputs} were announced")
        if value:
            made = [t.cast(value) for t in made]
        return made if outputs > 1 else made[0].named("v")

    return Node("combine", out, {m: extents[m] for m in out}, operands, run, outputs, fn=fn, weights=tuple(weights))


def evaluate(node: Node, slots: Sequence[Tensor] = (), seen: dict | None = None):
    """The tensor (or tensors) of a node; a node object met twice is built once."""
    seen = {} if seen is None else seen
    if id(node) in seen:
        return seen[id(node)][1]
    if node.kind == "slot":
        if node.slot >= len(slots):
            raise ValueError(f"slot {node.slot} is read before it is made")
        made = slots[node.slot].as_(*node.modes)
    else:
        parts = []
        for x in node.operands:
            t = evaluate(x, slots, seen)
            if isinstance(t, list):
                raise ValueError("a node with several outputs is read through its outputs")
            parts.append(t)
        made = node.run(*parts)
    seen[id(node)] = (node, made)
    return made


@dataclass(frozen=True)
class Output:
    """Output ``index`` of the node at place ``node`` of a graph."""

    node: int
    index: int
    modes: tuple[str, ...]
    extents: dict = field(hash=False)
    slot: int = 0

    def as_(self, *labels: str) -> Node:
        """A node that reads this output under the labels."""
        if len(labels) != len(self.modes):
            raise ValueError(f"{len(labels)} labels for an output of rank {len(self.modes)}")
        return slot(self.slot, labels, dict(zip(labels, self.extents.values())))

    def read(self) -> Node:
        return self.as_(*self.modes)


def _handles(node: Node, place: int, first: int) -> list[Output]:
    return [Output(place, k, node.modes, node.extents, first + k) for k in range(node.outputs)]


@dataclass(frozen=True)
class Graph:
    """Trees of nodes; immutable."""

    nodes: tuple[Node, ...] = ()

    def ops(self, *nodes: Node):
        """The graph with the nodes appended, and a handle for each output."""
        made = replace(self, nodes=self.nodes + nodes)
        first = sum(n.outputs for n in self.nodes)
        out = []
        for k, n in enumerate(nodes):
            out += _handles(n, len(self.nodes) + k, first + len(out))
        return (made, *out)

    def execute(self, *, only: Sequence[Output] | None = None) -> list[Tensor]:
        """Tensors of all outputs, in order (or of those asked for)."""
        seen: dict = {}
        flat: list[Tensor] = []
        for n in self.nodes:
            t = evaluate(n, (), seen)
            flat += t if isinstance(t, list) else [t]
        return flat if only is None else [flat[h.slot] for h in only]

    def execute_flat(self, sizes: Sequence[Mapping[str, int]]) -> Tensor:
        """The one output of a tree of contractions over inputs, by blocks of dense elements.

        ``sizes``: block sizes by label for each contraction, a node before its operands and the
        left before the right; labels that are left out are whole.
        """
        if len(self.nodes) != 1 or self.nodes[0].outputs != 1:
            raise ValueError("a flat list of blocks is for a graph of one output")
        waiting = list(sizes)

        def build(node: Node) -> Tensor:
            if node.kind == "relabel":
                return node.run(build(node.operands[0]))
            if node.kind == "input":
                return evaluate(node)
            if node.kind != "contraction":
                raise ValueError(f"a flat list of blocks is for contractions of inputs, not {node.kind}")
            if not waiting:
                raise ValueError("there are more contractions than maps of block sizes")
            own = waiting.pop(0)
            a, b = (build(x) for x in node.operands)
            blocks = [Blocked.of(t, {m: own[m] for m in t.modes if m in own}) for t in (a, b)]
            return node.finish(contract_blocked(*blocks, node.modes))

        out = build(self.nodes[0])
        if waiting:
            raise ValueError(f"{len(waiting)} maps of block sizes are left over")
        return out


@dataclass(frozen=True)
class Dag:
    """Nodes in order of definition that read each other's outputs; immutable."""

    nodes: tuple[Node, ...] = ()
    roots: tuple[Output, ...] = ()
    width: int | None = None

    def tasks(self, n: int) -> Dag:
        """How many tasks staged and shared results are dealt to when the graph runs (default: as Spark plans)."""
        if n < 1:
            raise ValueError(f"a run in {n} tasks")
        return replace(self, width=n)

    def add(self, node: Node):
        """The graph with the node, and one handle per output."""
        first = sum(n.outputs for n in self.nodes)
        for s in _slots_of(node):
            if s >= first:
                raise ValueError(f"slot {s} is read before it is made")
        return (replace(self, nodes=(*self.nodes, node)), *_handles(node, len(self.nodes), first))

    def outputs(self, *handles: Output) -> Dag:
        """Which outputs are wanted; they need not be the last."""
        if not handles:
            raise ValueError("a graph needs an output")
        return replace(self, roots=handles)

    def readers(self) -> list[int]:
        """How many nodes read each slot."""
        n = sum(x.outputs for x in self.nodes)
        count = [0] * n
        for node in self.nodes:
            for s in _slots_of(node):
                count[s] += 1
        return count

    def live(self) -> list[tuple[int, int]]:
        """First and last node at which each slot is needed (roots: to the end)."""
        out = []
        owner = [k for k, n in enumerate(self.nodes) for _ in range(n.outputs)]
        roots = {h.slot for h in self.roots}
        for s, k in enumerate(owner):
            users = [j for j, n in enumerate(self.nodes) if s in _slots_of(n)]
            out.append((k, len(self.nodes) if s in roots else max([k, *users])))
        return out

    def pools(self) -> list[int]:
        """A place for each slot, shared by slots that are never needed at once (left-edge colouring)."""
        free: list[int] = []  # last use by place
        out = []
        for first, last in self.live():
            for p, until in enumerate(free):
                if until < first:
                    free[p], place = last, p
                    break
            else:
                free.append(last)
                place = len(free) - 1
            out.append(place)
        return out

    def execute(self, persist: bool = True, release: bool = False, by: Mapping[int, Sequence[str]] | None = None) -> Run:
        """Tensors of the roots.

        ``persist``: results with two readers or more are made once and kept until the run is
        closed (staged inputs always are).  ``release``: all results are made at once, in order, and
        each is let go after its last reader was made, so that no more are kept than
        :meth:`pools` counts; only roots are left.  ``by``: labels by which the staged input
        at a place of the graph is dealt to tasks.
        """
        if not self.roots:
            raise ValueError("no outputs are designated")
        needed = self._needed()
        readers, live, slots, seen = self.readers(), self.live(), [], {}
        kept: dict[int, DataFrame] = {}  # by the first slot of the node
        most = 0
        for k, node in enumerate(self.nodes):
            first = len(slots)
            if k not in needed:
                slots += [None] * node.outputs
                continue
            made = evaluate(node, slots, seen)
            made = made if isinstance(made, list) else [made]
            shared = node.kind != "input" and sum(readers[first : first + len(made)]) > 1
            if node.kind == "stage" or (persist and shared) or release:
                frame = getattr(made[0], "frame", made[0].df)
                keys = [c for c in (by or {}).get(k, ()) if c in made[0].modes]
                if node.kind == "stage" and (self.width or keys):
                    frame = frame.repartition(*[x for x in (self.width,) if x], *keys)
                frame = kept[first] = frame.persist(StorageLevel.MEMORY_AND_DISK)
                made = [Tensor(frame, t.modes, t.value, t.extents, t.dense) for t in made]
                for t in made:
                    t.frame = frame
                if release:
                    frame.write.format("noop").mode("overwrite").save()
                    most = max(most, len(kept))
                    for s in [s for s in kept if s < first and max(live[s + i][1] for i in range(self._outputs_at(s))) <= k]:
                        kept.pop(s).unpersist()
            slots += made
        return Run([slots[h.slot] for h in self.roots], list(kept.values()), most)

    def _outputs_at(self, slot: int) -> int:
        """Outputs of the node whose first slot this is."""
        at = 0
        for n in self.nodes:
            if at == slot:
                return n.outputs
            at += n.outputs
        raise ValueError(f"no node begins at slot {slot}")

    def _needed(self) -> set[int]:
        owner = [k for k, n in enumerate(self.nodes) for _ in range(n.outputs)]
        open_, out = [owner[h.slot] for h in self.roots], set()
        while open_:
            k = open_.pop()
            if k not in out:
                out.add(k)
                open_ += [owner[s] for s in _slots_of(self.nodes[k])]
        return out

    def estimate(self) -> dict[str, int]:
        """Bytes of all slots by their extents (8 a value; unknown extents: 0), of the places that pooling needs, of the inputs, and of inputs and places."""
        sizes = []
        for n in self.nodes:
            total = 8
            for e in n.extents.values():
                total *= e or 0
            sizes += [total] * n.outputs
        pools: dict[int, int] = {}
        for p, b in zip(self.pools(), sizes):
            pools[p] = max(pools.get(p, 0), b)
        inputs = {id(x): x for n in self.nodes for x in _leaves(n)}
        operands = 0
        for x in inputs.values():
            total = 8
            for e in x.extents.values():
                total *= e or 0
            operands += total
        return {"slots": sum(sizes), "pools": sum(pools.values()), "num_pools": len(pools), "operands": operands, "all": operands + sum(pools.values())}


class Run(list):
    """Results of a graph; closing it releases what was kept.  ``most_kept``: results that were kept at once, if they were made in order."""

    def __init__(self, tensors: list[Tensor], kept: list, most_kept: int = 0):
        super().__init__(tensors)
        self.kept, self.most_kept = kept, most_kept

    def close(self) -> None:
        for df in self.kept:
            if df.sparkSession.sparkContext._jsc is not None:
                df.unpersist()
        self.kept = []

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def kept(run: Run, read: Callable[[Run], DataFrame]) -> DataFrame:
    """What ``read`` makes of a run; the run is closed once nothing holds that DataFrame any more."""
    df = read(run)
    weakref.finalize(df, run.close).atexit = False  # the session ends its caches itself
    return df


def _leaves(node: Node) -> list[Node]:
    return [node] if node.kind == "input" else [x for o in node.operands for x in _leaves(o)]


def _slots_of(node: Node) -> set[int]:
    out = {node.slot} if node.kind == "slot" else set()
    for x in node.operands:
        out |= _slots_of(x)
    return out
