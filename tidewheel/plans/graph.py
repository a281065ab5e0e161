"""Graphs: declare nodes and wanted outputs; what is needed, in which order, follows.

A node is a function of the DataFrames of its inputs. ``Graph`` walks inputs backwards from the outputs, so nodes and
lanes that no output needs are never built. A series that several nodes read is one DataFrame (and one exchange, which
Spark reuses); ``share`` names those worth writing once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.control import clocked
from tidewheel.plans.reach import UNIT, Reach


class GraphError(ValueError):
    pass


@dataclass(frozen=True)
class Read:
    """How a node reads an input: bare, ``buffering`` (a window), ``sampling`` (the last value), ``folding`` (a history
    of its own), or ``gating`` (a permission)."""

    node: str
    how: str = "bare"
    reach: Reach = UNIT
    on: tuple[str, ...] = ()
    passes: str = "passes"

    def __str__(self) -> str:
        return self.node if self.how == "bare" else f"{self.how}({self.node}{'' if self.reach == UNIT else f', {self.reach}'})"


def buffering(node: str, reach: Reach) -> Read:
    return Read(node, "buffering", reach)


def sampling(node: str) -> Read:
    return Read(node, "sampling")


def folding(node: str, reach: Reach) -> Read:
    return Read(node, "folding", reach)


def gating(node: str, on: tuple[str, ...] = (), passes: str = "passes") -> Read:
    """A permission. With ``on`` the graph applies it: the node's driving input keeps the rows whose ``on`` columns the
    gate's frame has with a true ``passes``, before the body sees them. Without, the body gets the gate's frame."""
    return Read(node, "gating", on=on, passes=passes)


@dataclass(frozen=True)
class Node:
    name: str
    reads: tuple[Read, ...]
    body: Callable[..., DataFrame]
    clock: int | None = None
    latch: bool = False
    anchored: bool = False
    fidelity: str = "exact"  # or partial, opaque
    cut: str | None = None  # of a latch: the node whose terminal element ends it
    ts: str = "ts"
    order: str = "seq"

    @property
    def clocked(self) -> bool:
        """A declared clock is enforced only where every input is retained; else it is a note."""
        return bool(self.clock) and all(r.how in ("buffering", "sampling", "gating") for r in self.reads)


def node(*reads: str | Read, **flags) -> Callable[[Callable], Node]:
    """A decorator: the function's name names the node. ``flags`` are the other fields of ``Node``.

    An enforced ``clock`` (in ns of the column ``ts``) keeps those rows of the driving input, the first that is no gate,
    at which a period begins by ``order``; gates are applied first, so a shut gate consumes no period.
    """

    def make(f: Callable) -> Node:
        return Node(f.__name__, tuple(Read(r) if isinstance(r, str) else r for r in reads), f, **flags)

    return make


@dataclass
class Graph:
    """``roots``: lane names; ``nodes``: all that may be used; ``outputs``: names wanted; ``alias``: name -> node."""

    roots: tuple[str, ...]
    nodes: Iterable[Node]
    outputs: tuple[str, ...]
    alias: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.roots, self.outputs = tuple(self.roots), tuple(self.outputs)
        if not self.roots or not self.outputs:
            raise GraphError("a graph needs a root and an output")
        names = [*self.roots, *(n.name for n in self.nodes)]
        if twice := {n for n in names if names.count(n) > 1}:
            raise GraphError(f"names stand twice: {sorted(twice)}")
        self.by_name = {n.name: n for n in self.nodes}
        self.order = self._order()
        self._check()

    def resolve(self, name: str) -> str:
        return self.alias.get(name, name)

    def _order(self) -> list[str]:
        done: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            name = self.resolve(name)
            if name in done:
                return
            if name in path:
                raise GraphError("a cycle: " + " -> ".join([*path[path.index(name) :], name]))
            if name not in self.by_name and name not in self.roots:
                raise GraphError(f"unknown: {name}")
            path.append(name)
            for r in self.by_name[name].reads if name in self.by_name else ():
                visit(r.node)
            path.pop()
            done.append(name)

        for o in self.outputs:
            visit(o)
        return done

    def _check(self) -> None:
        for name in self.order:
            if name not in self.by_name:
                continue
            n = self.by_name[name]
            gates = [i for i, r in enumerate(n.reads) if r.how == "gating"]
            if gates and gates != list(range(len(gates))):
                raise GraphError(f"{name}: gates come first")
            if gates and any(r.how == "folding" for r in n.reads):
                raise GraphError(f"{name}: a gated node may not fold")
            if n.latch and n.cut and not self.cut_gated(name, n.cut):
                raise GraphError(f"{name}: its cut {n.cut} isn't gated on it")
            if n.latch and self.deadlocked(name):
                raise GraphError(f"{name}: what arms it is gated on it, so it can never arm again")
            if n.clock:
                for r in n.reads:
                    feed = self.by_name.get(self.resolve(r.node))
                    if feed and feed.clock and n.clock % feed.clock:
                        raise GraphError(f"{name}: clock {n.clock} isn't a multiple of {feed.name}'s {feed.clock}")
            if n.anchored and (any(self.resolve(r.node) not in self.roots for r in n.reads) or any(r.how == "folding" for r in n.reads)):
                raise GraphError(f"{name}: an anchored node reads roots only, and folds none")

    def contains(self, name: str) -> bool:
        return self.resolve(name) in self.order

    def gates_on(self, name: str, gate: str) -> bool:
        """Whether a node reads ``gate`` as a gate. Roots are never gated."""
        n = self.by_name.get(self.resolve(name))
        return bool(n) and any(r.how == "gating" and self.resolve(r.node) == self.resolve(gate) for r in n.reads)

    def cut_gated(self, latch: str, cut: str) -> bool:
        """A latch is ended from within: its cut must be a node gated on it."""
        return self.gates_on(cut, latch)

    def deadlocked(self, latch: str) -> bool:
        """A latch armed by a node that it gates would be dark exactly when it is needed."""
        return any(self.gates_on(r.node, latch) for r in self.by_name[latch].reads)

    @property
    def required_lanes(self) -> list[str]:
        """The roots that an output needs."""
        return [r for r in self.roots if r in self.order]

    @property
    def reaches(self) -> dict[str, Reach]:
        """For each series the join of all reaches that read it."""
        out: dict[str, Reach] = {}
        for name in self.order:
            for r in self.by_name[name].reads if name in self.by_name else ():
                if r.how == "buffering":
                    key = self.resolve(r.node)
                    out[key] = out.get(key, UNIT).join(r.reach)
        return out

    @property
    def demand(self) -> dict[str, frozenset[frozenset[str]] | str]:
        """For each node: ``pin:<why>`` if it must run at all times, else the sets of gates any of which, all open, need it.

        Sets that hold another are dropped. Outputs, folds, latches, gates and retained series are pinned.
        """
        out: dict[str, frozenset[frozenset[str]] | str] = {}
        readers: dict[str, list[tuple[str, Read]]] = {n: [] for n in self.order}
        for name in self.order:
            for r in self.by_name[name].reads if name in self.by_name else ():
                readers[self.resolve(r.node)].append((name, r))
        for name in reversed(self.order):
            n = self.by_name.get(name)
            if name in map(self.resolve, self.outputs) and not any(r.how == "gating" for r in (n.reads if n else ())):
                out[name] = "pin:output"
            elif n and n.latch:
                out[name] = "pin:latch"
            elif n and any(r.how == "folding" for r in n.reads):
                out[name] = "pin:fold"
            elif any(r.how == "gating" for _, r in readers[name]):
                out[name] = "pin:gate"
            elif any(r.how in ("buffering", "sampling") for _, r in readers[name]):
                out[name] = "pin:retention"
            else:
                terms: set[frozenset[str]] = set()
                for reader, _ in readers[name]:
                    gates = frozenset(self.resolve(r.node) for r in self.by_name[reader].reads if r.how == "gating")
                    above = out[reader]
                    terms |= {gates} if isinstance(above, str) else {gates | t for t in above}
                if name in map(self.resolve, self.outputs):
                    terms.add(frozenset(self.resolve(r.node) for r in n.reads if r.how == "gating"))
                out[name] = frozenset(t for t in terms if not any(o < t for o in terms))
                if frozenset() in out[name]:
                    out[name] = "pin:flow"
        return out

    def live(self, name: str, open_gates: set[str]) -> bool:
        """Whether a node is needed while just these gates are open."""
        d = self.demand[self.resolve(name)]
        return isinstance(d, str) or any(t <= open_gates for t in d)

    def explain(self, open_gates: set[str] | None = None) -> str:
        """One line for each node, in order; with ``open_gates`` those asleep are marked."""
        lines = []
        for name in self.order:
            n = self.by_name.get(name)
            d = self.demand[name]
            need = d if isinstance(d, str) else " | ".join(" & ".join(sorted(t)) for t in sorted(d, key=sorted))
            asleep = "  asleep" if open_gates is not None and not self.live(name, open_gates) else ""
            kept = f"  keeps {self.reaches[name]}" if name in self.reaches else ""
            lines.append(f"{name} <- {', '.join(map(str, n.reads)) if n else 'lane'}  [{need}]{kept}{asleep}")
        return "\n".join(lines)

    @property
    def fidelity(self) -> dict[str, int]:
        kinds = [self.by_name[n].fidelity for n in self.order if n in self.by_name]
        return {k: kinds.count(k) for k in ("exact", "partial", "opaque")}

    def build(self, lanes: dict[str, DataFrame | Callable[[], DataFrame]], share: Callable[[str, DataFrame], DataFrame] | None = None, observer: Callable[[str, DataFrame], None] | None = None) -> dict[str, DataFrame]:
        """The outputs. Lanes may be functions, which are called only if needed.

        Gates with ``on``, and enforced clocks, act on a node's driving input before its body. ``share`` may write a
        node's frame once for all its readers; ``observer`` sees each node's frame and changes nothing.
        """
        made: dict[str, DataFrame] = {}
        for name in self.order:
            if name in self.roots:
                lane = lanes[name]
                made[name] = lane() if callable(lane) else lane
            else:
                made[name] = self._run(self.by_name[name], made)
            if share:
                made[name] = share(name, made[name])
            if observer:
                observer(name, made[name])
        return {o: made[self.resolve(o)] for o in self.outputs}

    def _run(self, n: Node, made: dict[str, DataFrame]) -> DataFrame:
        acting = [r for r in n.reads if r.how == "gating" and r.on]
        args = [made[self.resolve(r.node)] for r in n.reads if r not in acting]
        driver = next((i for i, r in enumerate(r for r in n.reads if r not in acting) if r.how != "gating"), None)
        if driver is not None:
            for r in acting:
                open_ = made[self.resolve(r.node)].where(F.coalesce(F.col(r.passes), F.lit(False))).select(*r.on)
                args[driver] = args[driver].join(open_, list(r.on), "left_semi")
            if n.clocked:
                args[driver] = clocked(args[driver], n.clock, n.ts, n.order)
        return n.body(*args)

    def census(self, lanes: dict, values: dict[str, str]) -> DataFrame:
        """node, fires, skips of the nodes named in ``values`` (node -> its value column): one pass over each."""
        from tidewheel.plans.observe import census

        seen: dict[str, DataFrame] = {}
        self.build(lanes, observer=seen.__setitem__)
        return census({n: (seen[self.resolve(n)], v) for n, v in values.items()})
