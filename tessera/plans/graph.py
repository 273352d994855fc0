"""A typed dataflow graph over body states that binds to column expressions.

A graph is declared (in Python or XML), checked strictly, ordered, and becomes one ``select``: nodes are expressions,
links are references, and Catalyst plans the rest. Types must match exactly; nothing is coerced.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Types of sockets and the Spark types that they bind to.
TYPES = {"double": "double", "long": "bigint", "bool": "boolean", "string": "string", "vector": "array<double>"}


class GraphError(ValueError):
    pass


@dataclass
class Kind:
    """A node kind: input and output types by socket name, and how outputs follow from inputs."""

    inputs: dict[str, str]
    outputs: dict[str, str]
    compute: Callable[..., dict[str, Column]] | None = None
    defaults: dict[str, object] = field(default_factory=dict)
    sink: bool = False
    #: What a reducing kind comes to without any body; such a kind computes aggregates.
    empty: dict[str, object] | None = None


KINDS: dict[str, Kind] = {}


def register(name: str, kind: Kind) -> None:
    """Adds a node kind; a plug-in may do so too."""
    for t in [*kind.inputs.values(), *kind.outputs.values()]:
        if t not in TYPES:
            raise GraphError(f"{name}: unknown type {t}")
    KINDS[name] = kind


for _t in TYPES:
    register(f"constant.{_t}", Kind({}, {"value": _t}, None))
register("dot", Kind({"a": "vector", "b": "vector"}, {"result": "double"}, lambda a, b: {"result": V.dot(a, b)}))
register("norm", Kind({"value": "vector"}, {"result": "double"}, lambda value: {"result": V.norm(value)}))
register("component", Kind({"value": "vector", "index": "long"}, {"result": "double"}, lambda value, index: {"result": V.component(value, index.cast("int"))}, {"index": 0}))
register(
    "transform",
    Kind(
        {"value": "vector", "rotation": "vector", "translation": "vector"}, {"result": "vector"},
        lambda value, rotation, translation: {"result": V.transform(rotation, translation, value)},
        {"value": [0.0] * 3, "rotation": [0.0, 0.0, 0.0, 1.0], "translation": [0.0] * 3},
    ),
)
register("sum_plus_one", Kind({"a": "double", "b": "double"}, {"x": "double", "y": "double"}, lambda a, b: {"x": a + b + 1, "y": a + b + 1}, {"a": 0.0, "b": 0.0}))
register("stop", Kind({"enable": "bool"}, {}, None, {"enable": False}))
register("line", Kind({"value": "double"}, {}, None, sink=True))
register("line.vector", Kind({"value": "vector"}, {}, None, sink=True))
register("line.string", Kind({"value": "string"}, {}, None, sink=True))


def lookup_kind(table: dict, default, key_type: str = "long", value_type: str = "string") -> Kind:
    """A lookup in a small literal table; tables of any size are joined with ``operators.pairs.lookup``."""

    def compute(key: Column, enable: Column) -> dict[str, Column]:
        found = F.lit(default)
        if table:
            found = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))
        return {"value": F.when(enable, found)}

    return Kind({"key": key_type, "enable": "bool"}, {"value": value_type}, compute, {"enable": True})


@dataclass
class Node:
    kind: str
    values: dict[str, object] = field(default_factory=dict)
    priority: int = 0


class Graph:
    """Nodes by name, and links from an output to inputs. ``sources`` are columns of the rows the graph runs on."""

    def __init__(self, sources: dict[str, str]):
        self.sources = sources
        self.nodes: dict[str, Node] = {}
        self.links: dict[tuple[str, str], tuple[str, str]] = {}

    def add(self, name: str, kind: str, priority: int = 0, **values) -> Graph:
        if name in self.nodes or name == "source":
            raise GraphError(f"node {name} exists")
        if kind not in KINDS:
            raise GraphError(f"unknown kind {kind}")
        if unknown := values.keys() - KINDS[kind].inputs.keys() - ({"value"} if kind.startswith("constant.") else set()):
            raise GraphError(f"{name} has no input {sorted(unknown)}")
        self.nodes[name] = Node(kind, values, priority)
        return self

    def _output_type(self, name: str, socket: str) -> str:
        outputs = self.sources if name == "source" else KINDS[self._node(name).kind].outputs
        if socket not in outputs:
            raise GraphError(f"{name} has no output {socket}")
        return outputs[socket]

    def _node(self, name: str) -> Node:
        if name not in self.nodes:
            raise GraphError(f"no node {name}")
        return self.nodes[name]

    def link(self, start: str, output: str, end: str, input_: str) -> Graph:
        """Pull: the input takes its value from one output, of exactly its type; a repeated link is the same link."""
        inputs = KINDS[self._node(end).kind].inputs
        if input_ not in inputs:
            raise GraphError(f"{end} has no input {input_}")
        if (found := self._output_type(start, output)) != inputs[input_]:
            raise GraphError(f"{end}.{input_} takes {inputs[input_]}, not {found}")
        if self.links.get((end, input_), (start, output)) != (start, output):
            raise GraphError(f"{end}.{input_} is linked already")
        self.links[end, input_] = (start, output)
        return self

    def push(self, start: str, output: str, ends: list[tuple[str, str]]) -> Graph:
        """Push: one output to many inputs."""
        for end, input_ in ends:
            self.link(start, output, end, input_)
        return self

    def order(self) -> list[str]:
        """Nodes after what they depend on, then by priority and name; a cycle is an error."""
        before = {n: {s for (end, _), (s, _) in self.links.items() if end == n and s != "source"} for n in self.nodes}
        done: list[str] = []
        while len(done) < len(self.nodes):
            ready = [n for n in self.nodes if n not in done and before[n] <= set(done)]
            if not ready:
                raise GraphError("the graph has a cycle")
            done.append(min(ready, key=lambda n: (self.nodes[n].priority, n)))
        return done

    def bind(self, rows: DataFrame | None = None) -> tuple[dict[tuple[str, str], Column], Column | None]:
        """Expressions of all outputs and of all sinks' values, and when to stop (rows for which it holds are left out)."""
        if rows is not None:
            have = dict(rows.dtypes)
            for name, t in self.sources.items():
                if have.get(name) != TYPES[t]:
                    raise GraphError(f"source {name} must be {TYPES[t]}, not {have.get(name)}")
        out: dict[tuple[str, str], Column] = {("source", s): F.col(s) for s in self.sources}
        return out, self._compute(self.order(), out)

    def _compute(self, names: list[str], out: dict[tuple[str, str], Column]) -> Column | None:
        """Adds the outputs of the nodes ``names`` to ``out``; gives the condition of their stop nodes."""
        stop = None
        for name in names:
            node, kind = self.nodes[name], KINDS[self.nodes[name].kind]
            if node.kind.startswith("constant."):
                out[name, "value"] = _literal(node.values["value"], kind.outputs["value"])
                continue
            inputs = {}
            for socket, t in kind.inputs.items():
                if (name, socket) in self.links:
                    inputs[socket] = out[self.links[name, socket]]
                elif socket in node.values or socket in kind.defaults:
                    inputs[socket] = _literal(node.values.get(socket, kind.defaults.get(socket)), t)
                else:
                    raise GraphError(f"{name}.{socket} has no link and no value")
            if node.kind == "stop":
                stop = inputs["enable"] if stop is None else stop | inputs["enable"]
            elif kind.sink:
                out[name, "value"] = inputs["value"]
            else:
                out |= {(name, socket): c for socket, c in kind.compute(**inputs).items()}
        return stop

    def socket(self, name: str, socket: str) -> tuple[str, str] | None:
        """Direction and type of a node's socket; None where there is none."""
        kind = KINDS[self.nodes[name].kind] if name in self.nodes else None
        for direction, of in (("input", kind and kind.inputs), ("output", kind and kind.outputs)):
            if of and socket in of:
                return direction, of[socket]
        return None

    def value(self, name: str, socket: str, t: str):
        """The value that an unlinked input has, or a constant; asking for another type is an error."""
        found = self.socket(name, socket)
        if found is None or found[1] != t:
            raise GraphError(f"{name}.{socket} is {found[1] if found else 'nothing'}, not {t}")
        if (name, socket) in self.links:
            raise GraphError(f"{name}.{socket} takes its value from a link")
        node = self.nodes[name]
        return node.values.get(socket, KINDS[node.kind].defaults.get(socket))

    def set(self, name: str, socket: str, t: str, value) -> Graph:
        self.value(name, socket, t)
        self.nodes[name].values[socket] = value
        return self

    def run(self, rows: DataFrame, keep: list[str] = (), outputs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """One select: the columns ``keep``, and ``outputs`` by name (all sinks, if none are named; then one is needed)."""
        bound, stop = self.bind(rows)
        if outputs is None:
            outputs = {n: (n, "value") for n in self.nodes if KINDS[self.nodes[n].kind].sink}
            if not outputs:
                raise GraphError("the graph has no output node")
        if stop is not None:
            rows = rows.where(~F.coalesce(stop, F.lit(False)))
        return rows.select(*keep, *(bound[at].alias(name) for name, at in outputs.items()))


def _literal(value, t: str) -> Column:
    if t == "vector":
        return F.array(*(F.lit(float(x)) for x in value))
    return F.lit(value).cast(TYPES[t])


def parse(text: str) -> Graph:
    """A graph from XML: <graph><source name type/> <node name kind priority><value socket>...</value></node> <link from output to input/></graph>."""
    root = ET.fromstring(text)
    graph = Graph({_required(e, "name"): _required(e, "type") for e in root.iter("source")})
    for e in root.iter("node"):
        kind = _required(e, "kind")
        types = KINDS[kind].inputs | KINDS[kind].outputs if kind in KINDS else {}
        values = {_required(v, "socket"): _parsed(v.text or "", types.get(v.get("socket"), "string")) for v in e.iter("value")}
        graph.add(_required(e, "name"), kind, int(e.get("priority", 0)), **values)
    for e in root.iter("link"):
        graph.link(*(_required(e, k) for k in ("from", "output", "to", "input")))
    return graph


def _required(element: ET.Element, name: str) -> str:
    if element.get(name) is None:
        raise GraphError(f"<{element.tag}> needs {name}")
    return element.get(name)


def _parsed(text: str, t: str):
    if t == "vector":
        return [float(x) for x in text.split()]
    if t == "bool":
        return {"true": True, "1": True, "false": False, "0": False}[text.strip()]
    return {"double": float, "long": int, "string": str}[t](text)
