"""Graphs in stages: nodes that run before the bodies of a state, for each body, and after them.

A node stands in one of the ``STAGES``. What runs before the state sees the state's own columns; body nodes see those,
the body's columns and all that came before; nodes after the state see the state, and the bodies through reducing kinds
only. Values never go back to an earlier stage. The planner makes three steps of it, whatever the number of nodes: a map
over the states, a join and a map over their bodies with one aggregation by state, and a map over its results.

A group of nodes is added as one: its members stand in stages of their own, and are linked by the group's name and theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import KINDS, TYPES, Graph, GraphError, Kind, register

STAGES = ("frame_init", "body", "frame_final")

register("reduce.sum", Kind({"value": "double"}, {"result": "double"}, lambda value: {"result": F.sum(value)}, empty={"result": 0.0}))
register("reduce.count", Kind({"value": "double"}, {"result": "long"}, lambda value: {"result": F.count(value)}, empty={"result": 0}))
register("reduce.least", Kind({"value": "double"}, {"result": "double"}, lambda value: {"result": F.min(value)}, empty={"result": None}))
register("reduce.greatest", Kind({"value": "double"}, {"result": "double"}, lambda value: {"result": F.max(value)}, empty={"result": None}))
register("reduce.mean_vector", Kind({"value": "vector"}, {"result": "vector"}, lambda value: {"result": F.array(*(F.avg(value[i]) for i in range(3)))}, empty={"result": None}))
register("text", Kind({"value": "double"}, {"result": "string"}, lambda value: {"result": value.cast("string")}))
register("number", Kind({"value": "long"}, {"result": "double"}, lambda value: {"result": value.cast("double")}))
register("joined_text", Kind({"a": "string", "b": "string"}, {"result": "string"}, lambda a, b: {"result": F.concat(a, b)}))


@dataclass
class Frames:
    """What the sinks of each stage have received: rows by state, by body, and by state."""

    frame_init: DataFrame | None
    body: DataFrame | None
    frame_final: DataFrame | None


class StagedGraph(Graph):
    """``sources`` are columns of the bodies, ``state_sources`` of the states, named ``state`` in links; ``key`` joins them."""

    def __init__(self, key: str, sources: dict[str, str], state_sources: dict[str, str]):
        super().__init__(sources)
        self.key, self.state_sources = key, state_sources
        self.stage: dict[str, str] = {}

    def add(self, name: str, kind: str, priority: int = 0, stage: str = "body", **values) -> StagedGraph:
        if stage not in STAGES:
            raise GraphError(f"no stage {stage}")
        if name == "state":
            raise GraphError("node state exists")
        if kind in KINDS and KINDS[kind].empty is not None and stage != "frame_final":
            raise GraphError(f"{name} reduces bodies, which is done in frame_final only")
        super().add(name, kind, priority, **values)
        self.stage[name] = stage
        return self

    def add_group(self, name: str, members: dict[str, tuple[str, str, dict]]) -> StagedGraph:
        """Nodes ``name.member``, each of a (stage, kind, values)."""
        for member, (stage, kind, values) in members.items():
            self.add(f"{name}.{member}", kind, stage=stage, **values)
        return self

    def _output_type(self, name: str, socket: str) -> str:
        if name == "state":
            if socket not in self.state_sources:
                raise GraphError(f"the state has no output {socket}")
            return self.state_sources[socket]
        return super()._output_type(name, socket)

    def _stage_of(self, name: str) -> int:
        return {"state": 0, "source": 1}.get(name) if name in ("state", "source") else STAGES.index(self.stage[name])

    def link(self, start: str, output: str, end: str, input_: str) -> StagedGraph:
        super().link(start, output, end, input_)
        before, after = self._stage_of(start), self._stage_of(end)
        reduces = KINDS[self.nodes[end].kind].empty is not None
        wrong = None
        if before > after:
            wrong = f"{end} runs before {start}"
        elif after == 2 and before == 1 and not reduces:
            wrong = f"{end} runs once a state and needs a reducing kind for {start}.{output}"
        elif reduces and before != 1:
            wrong = f"{end} reduces bodies, not {start}.{output}"
        if wrong:
            del self.links[end, input_]
            raise GraphError(wrong)
        return self

    def order(self) -> list[str]:
        before = {n: {s for (end, _), (s, _) in self.links.items() if end == n and s not in ("source", "state")} for n in self.nodes}
        done: list[str] = []
        while len(done) < len(self.nodes):
            ready = [n for n in self.nodes if n not in done and before[n] <= set(done)]
            if not ready:
                raise GraphError("the graph has a cycle")
            done.append(min(ready, key=lambda n: (self._stage_of(n), KINDS[self.nodes[n].kind].empty is None, self.nodes[n].priority, n)))
        return done

    def _checked(self, rows: DataFrame, sources: dict[str, str], what: str) -> None:
        have = dict(rows.dtypes)
        for name, t in sources.items():
            if have.get(name) != TYPES[t]:
                raise GraphError(f"{what} {name} must be {TYPES[t]}, not {have.get(name)}")

    def run_frames(self, states: DataFrame, bodies: DataFrame, keep: list[str] = ()) -> Frames:
        """All stages; ``keep`` are columns of the bodies that go with their results. States without bodies run too, bodies without a state don't."""
        self._checked(states, self.state_sources, "state")
        self._checked(bodies, self.sources, "source")
        names = {stage: [n for n in self.order() if self.stage[n] == stage] for stage in STAGES}
        sinks = {stage: [n for n in names[stage] if KINDS[self.nodes[n].kind].sink] for stage in STAGES}
        if not any(sinks.values()):
            raise GraphError("the graph has no output node")
        column = lambda at: f"_{at[0]}.{at[1]}".replace(".", "_")

        def stepped(rows: DataFrame, stage: list[str], out: dict) -> tuple[DataFrame, dict]:
            """``rows`` with the outputs of ``stage`` as columns, but without those at which the stage stops."""
            known = set(out)
            stop = self._compute(stage, out)
            new = {at: c for at, c in out.items() if at not in known}
            rows = rows.where(~F.coalesce(stop, F.lit(False))) if stop is not None else rows
            return rows.withColumns({column(at): c for at, c in new.items()}), out | {at: F.col(column(at)) for at in new}

        key = self.key
        given = states.select(key, *(F.col(s).alias(column(("state", s))) for s in self.state_sources))
        frames, out = stepped(given, names["frame_init"], {("state", s): F.col(column(("state", s))) for s in self.state_sources})
        of_frames = dict(out)
        rows = bodies.select(*dict.fromkeys([key, *keep, *self.sources])).join(frames, key)
        rows, out = stepped(rows, names["body"], out | {("source", s): F.col(s) for s in self.sources})
        reducing = [n for n in names["frame_final"] if KINDS[self.nodes[n].kind].empty is not None]
        reduced = dict(out)
        self._compute(reducing, reduced)
        sums: dict[tuple[str, str], Column] = {at: c for at, c in reduced.items() if at[0] in reducing}
        final = frames
        if sums:
            by_state = rows.groupBy(key).agg(*(c.alias(column(at)) for at, c in sums.items()))
            empty = lambda at: KINDS[self.nodes[at[0]].kind].empty[at[1]]
            final = frames.join(by_state, key, "left").withColumns({column(at): F.coalesce(column(at), F.lit(empty(at))) for at in sums if empty(at) is not None})
        final, out = stepped(final, [n for n in names["frame_final"] if n not in reducing], of_frames | {at: F.col(column(at)) for at in sums})
        shown = lambda rows, stage, more=(): rows.select(*dict.fromkeys([key, *more]), *(F.col(column((n, "value"))).alias(n) for n in sinks[stage])) if sinks[stage] else None
        return Frames(shown(frames, "frame_init"), shown(rows, "body", keep), shown(final, "frame_final"))


def script(graph: StagedGraph, frames: Frames, order: str) -> DataFrame:
    """key, stage (0 to 2), ``order`` and line: what a writer of text puts out for each state, in this order; ``order`` is among the bodies' kept columns."""
    parts = []
    for i, rows in enumerate((frames.frame_init, frames.body, frames.frame_final)):
        if rows is not None:
            sinks = [c for c in rows.columns if c in graph.nodes]
            place = F.col(order) if i == 1 else F.lit(None)
            parts.append(rows.select(graph.key, F.lit(i).alias("stage"), place.cast("long").alias(order), F.explode(F.array(*(F.col(f"`{c}`").cast("string") for c in sinks))).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
