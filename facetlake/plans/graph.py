"""Derivation graphs: named nodes over columns.

Only nodes that an output needs are built (liveness), each once (memo); cycles and unknown inputs raise.  ``apply`` lowers a
graph of row expressions to one chain of projections.  ``run`` takes whole-column nodes (``breakers``) and columns of
different dimension lists as well: the graph is cut into stages at its whole-column nodes; a stage's numbers over one layout
come from one aggregate, its group reductions by one column from another, and all between are projections that Spark fuses.
A node's layout is the union of its inputs' dimensions; columns of fewer dimensions are repeated by a join on those.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nodes import NODES
from ..operators.dims import inflate
from .breakers import BREAKERS

Dims = tuple[str, ...]


@dataclass
class Graph:
    steps: dict[str, tuple[str, list, dict]] = field(default_factory=dict)
    #: the node that a column of several belongs to
    parts: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, op: str, *inputs, **params) -> "Graph":
        node = NODES.get(op) or BREAKERS.get(op)
        if node is None:
            raise KeyError(f"no node {op}")
        if node.arity not in (-1, len(inputs)):
            raise ValueError(f"{op} takes {node.arity} inputs")
        if op in BREAKERS and not all(isinstance(i, str) for i in inputs):
            raise ValueError(f"{op} takes columns only")
        self.steps[name] = (op, list(inputs), params)
        if op in BREAKERS:
            self.parts |= {f"{name}{k}": name for k in range(BREAKERS[op].width(params) or 0)}
        return self

    def order(self, outputs: list[str]) -> list[str]:
        done: list[str] = []
        path: list[str] = []

        def visit(n: str) -> None:
            n = self.parts.get(n, n)
            if n in done or n not in self.steps:
                return
            if n in path:
                raise ValueError("cycle through " + n)
            path.append(n)
            for i in self.steps[n][1]:
                if isinstance(i, str):
                    visit(i)
            path.pop()
            done.append(n)

        for o in outputs:
            if self.parts.get(o, o) not in self.steps:
                raise KeyError(f"no node named {o}")
            visit(o)
        return done

    def apply(self, df: DataFrame, outputs: list[str]) -> DataFrame:
        if not outputs:
            raise ValueError("a graph needs an output")
        names = self.order(outputs)
        if any(self.steps[n][0] in BREAKERS for n in names):
            raise ValueError("whole-column nodes need run()")
        given = df.columns
        for n in names:
            op, inputs, params = self.steps[n]
            df = df.withColumn(n, NODES[op].build(*map(operand, inputs), **params))
        return df.select(*given, *[o for o in outputs if o not in given])

    def run(self, layouts: dict[Dims, DataFrame], outputs: list[str], aggregates: list[DataFrame] | None = None) -> DataFrame:
        """Dimensions and ``outputs`` over the union of the outputs' dimensions.

        ``layouts`` holds a table per dimension list: a row per coordinates, a column per attribute; () is one row of
        constants.  A coordinate that a smaller layout lacks gives null.  Null groups form one group.  ``aggregates``, if
        given, receives the aggregate of each stage and layout.
        """
        if not outputs:
            raise ValueError("a graph needs an output")
        return _Run(self, layouts, aggregates if aggregates is not None else []).outputs(outputs)

    def write_back(self, df: DataFrame, outputs: list[str]) -> tuple[DataFrame, DataFrame]:
        """The table with its derived columns, and their new bounds (attribute, lo, hi) from one pass."""
        out = self.apply(df, outputs)
        row = out.agg(*[x for o in outputs for x in (F.min(o).cast("double").alias(f"lo|{o}"), F.max(o).cast("double").alias(f"hi|{o}"))])
        return out, row.select(F.expr(f"stack({len(outputs)}, " + ", ".join(f"'{o}', `lo|{o}`, `hi|{o}`" for o in outputs) + ") as (attribute, lo, hi)"))


def operand(i):
    return F.col(i) if isinstance(i, str) else F.lit(float(i))


class _Run:
    """One evaluation: the table of each layout so far, and the layout and stage of each column."""

    def __init__(self, graph: Graph, layouts: dict[Dims, DataFrame], aggregates: list[DataFrame]):
        self.graph, self.aggregates = graph, aggregates
        self.rank: dict[str, int] = {}  # dimensions in the order in which layouts name them
        self.frames: dict[Dims, DataFrame] = {}
        self.layout: dict[str, Dims] = {}
        self.stage: dict[str, int] = {}
        for dims, df in layouts.items():
            for d in dims:
                self.rank.setdefault(d, len(self.rank))
        for dims, df in layouts.items():
            key = self.union([dims])
            self.frames[key] = df
            for name in df.columns:
                if name in self.layout or name in graph.steps or name in graph.parts:
                    raise ValueError(f"{name} stands for two columns")
                if name not in dims:
                    self.layout[name], self.stage[name] = key, 0

    def union(self, several: list[Dims]) -> Dims:
        return tuple(sorted({d for dims in several for d in dims}, key=self.rank.__getitem__))

    def outputs(self, outputs: list[str]) -> DataFrame:
        nodes = self.graph.order(outputs)
        for n in nodes:
            op, inputs, _ = self.graph.steps[n]
            used = [i for i in inputs if isinstance(i, str)]
            for i in used:
                if i not in self.layout:
                    raise KeyError(f"no column {i}")
            for column in (n, *[c for c, whole in self.graph.parts.items() if whole == n]):
                self.layout[column] = self.union([self.layout[i] for i in used])
                self.stage[column] = max((self.stage[i] for i in used), default=0) + (op in BREAKERS)
        last = max(self.stage[n] for n in nodes)
        late = dict.fromkeys(nodes, last)  # row nodes as late as their users allow: no join stands below an aggregate that does not need it
        for n in reversed(nodes):
            whole = self.graph.steps[n][0] in BREAKERS
            self.stage[n] = self.stage[n] if whole else late[n]
            for i in self.inputs(n):
                if (maker := self.graph.parts.get(i, i)) in late:
                    late[maker] = min(late[maker], self.stage[n] - whole)
        for stage in range(last + 1):
            here = [n for n in nodes if self.stage[n] == stage]
            self.whole([n for n in here if self.graph.steps[n][0] in BREAKERS])
            self.rows([n for n in here if self.graph.steps[n][0] not in BREAKERS])
        target = self.union([self.layout[o] for o in outputs])
        self.bring(target, outputs)
        return self.frames[target].select(*target, *outputs)

    def inputs(self, n: str) -> list[str]:
        return [i for i in self.graph.steps[n][1] if isinstance(i, str)]

    def bring(self, target: Dims, names: list[str]) -> None:
        """Give the target's table the columns that other layouts hold, one join per layout."""
        if target not in self.frames:
            first, *rest = sorted({self.layout[n] for n in names}, key=len, reverse=True)
            made, dims = self.frames[first].select(*first), first
            for other in rest:
                if set(other) - set(dims):  # new coordinates: the smaller side is the repeated one
                    made, dims = inflate(made, self.frames[other].select(*other), list(dims), list(other)), self.union([dims, other])
            self.frames[target] = made
        there = set(self.frames[target].columns)
        missing: dict[Dims, list[str]] = defaultdict(list)
        for n in dict.fromkeys(names):
            if n not in there:
                missing[self.layout[n]].append(n)
        for source, columns in missing.items():
            small = self.frames[source].select(*source, *columns)
            self.frames[target] = self.frames[target].join(small, list(source), "left") if source else self.frames[target].crossJoin(F.broadcast(small))

    def rows(self, nodes: list[str]) -> None:
        """Row expressions of a stage, in order; what a layout needs from others comes with the first node that needs any."""
        done: set[str] = set()
        for n in nodes:
            op, inputs, params = self.graph.steps[n]
            target = self.layout[n]
            if target not in self.frames or set(self.inputs(n)) - set(self.frames[target].columns):
                ready = {i for m in nodes if self.layout[m] == target for i in self.inputs(m) if i in done or i not in nodes}
                self.bring(target, [*self.inputs(n), *sorted(ready)])
            self.frames[target] = self.frames[target].withColumn(n, NODES[op].build(*map(operand, inputs), **params))
            done.add(n)

    def whole(self, nodes: list[str]) -> None:
        """Whole-column nodes of a stage: one aggregate per layout, one per layout and group column, then single operators."""
        by_layout: dict[Dims, list[str]] = defaultdict(list)
        for n in nodes:
            by_layout[self.layout[n]].append(n)
        for dims, mine in by_layout.items():
            kinds: dict[str, list[str]] = defaultdict(list)
            for n in mine:
                kinds[BREAKERS[self.graph.steps[n][0]].kind].append(n)
            for kind, take in (("table", self.numbers), ("group", self.groups), ("frame", self.singles)):
                if kinds[kind]:
                    self.bring(dims, [i for n in kinds[kind] for i in self.inputs(n)])  # no join before it is needed
                    take(dims, kinds[kind])

    def singles(self, dims: Dims, nodes: list[str]) -> None:
        for n in nodes:
            op, inputs, params = self.graph.steps[n]
            self.frames[dims] = BREAKERS[op].build(self.frames[dims], inputs, dims, n, params)

    def numbers(self, dims: Dims, nodes: list[str]) -> None:
        gathered = {}
        for n in nodes:
            op, inputs, params = self.graph.steps[n]
            gathered |= {(n, k): v.alias(f"{n}|{k}") for k, v in BREAKERS[op].gather(list(map(F.col, inputs)), params).items()}
        self.aggregates.append(self.frames[dims].agg(*gathered.values()))
        row = self.aggregates[-1].first()
        for n in nodes:
            op, inputs, params = self.graph.steps[n]
            found = {k: row[f"{n}|{k}"] for m, k in gathered if m == n}
            self.frames[dims] = self.frames[dims].withColumns({n + suffix: x for suffix, x in BREAKERS[op].build(list(map(F.col, inputs)), found, params).items()})

    def groups(self, dims: Dims, nodes: list[str]) -> None:
        by: dict[str, list[str]] = defaultdict(list)
        for n in nodes:
            by[self.graph.steps[n][1][1]].append(n)
        for group, mine in by.items():
            df = self.frames[dims].withColumn("_group", F.floor(F.col(group)).cast("long"))
            sums = [BREAKERS[self.graph.steps[n][0]].gather(F.col(self.graph.steps[n][1][0]), self.graph.steps[n][2]).alias(n) for n in mine]
            found = df.groupBy(F.col("_group").alias("_of")).agg(*sums)
            self.aggregates.append(found)
            self.frames[dims] = df.join(found, F.col("_group").eqNullSafe(F.col("_of")), "left").drop("_group", "_of")
