"""Exploration of implicit state spaces: states are bytes, edges come from a successor function.

A state met again, also as an initial state twice, is one state; a transition met again counts again. Without initial
states all tables are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import beside, with_row_number
from ..graph import Graph
from ..storage import stored
from .components import component_sizes, strong_components
from .iterate import counted

Successors = Callable[[bytes], Iterable[bytes]]
STEP = "state binary, error string, next binary"
MOST_TABLES = 24


@dataclass
class Exploration:
    """states (state, depth), transitions (src, dst), errors (state, error); complete: whether the depth limit cut nothing off."""

    states: DataFrame
    transitions: DataFrame
    errors: DataFrame
    complete: bool

    def statistics(self) -> DataFrame:
        """One row: stored states, matched states (reached again), transitions, greatest depth, longest state."""
        s = self.states.agg(F.count(F.lit(1)).alias("stored"), F.max("depth").alias("max_depth"), F.max(F.octet_length("state")).alias("max_state_bytes"))
        t = self.transitions.agg(F.count(F.lit(1)).alias("transitions"))
        return beside(s, t).select("stored", (F.col("transitions") - F.col("stored") + 1).alias("matched"), "transitions", "max_depth", "max_state_bytes")

    def deadlocks(self, is_end: Callable[[bytes], bool] | None = None) -> DataFrame:
        """(state): no end state, no successor, no error."""
        rows = self.states.select("state").join(self.transitions.select(F.col("src").alias("state")).distinct(), "state", "left_anti")
        rows = rows.join(self.errors.select("state"), "state", "left_anti")
        return rows if is_end is None else rows.filter(~predicate(is_end)("state"))

    def graph(self) -> tuple[Graph, DataFrame]:
        """The explored graph over numbers, and (id, state)."""
        names = stored(with_row_number(self.states.select("state"), "state", name="id"), "names")
        a, b = names.select(F.col("state").alias("src_state"), F.col("id").alias("src")), names.select(F.col("state").alias("dst_state"), F.col("id").alias("dst"))
        t = self.transitions.select(F.col("src").alias("src_state"), F.col("dst").alias("dst_state"))
        edges = t.join(a, "src_state").join(b, "dst_state").select("src", "dst")
        return Graph(names.select("id"), edges), names

    def accepting_cycle_states(self, accepting: Callable[[bytes], bool]) -> DataFrame:
        """(state): accepting states on a cycle, that is in a component of several states or with a loop of their own."""
        graph, names = self.graph()
        graph = graph.materialized()
        comps = strong_components(graph)
        large = component_sizes(comps).filter("size > 1").select("comp")
        cyclic = comps.join(large, "comp", "left_semi").select("id").union(graph.edges.filter("src = dst").select(F.col("src").alias("id"))).distinct()
        return names.join(cyclic, "id", "left_semi").select("state").filter(predicate(accepting)("state"))


@dataclass
class Check:
    """report: one row (stored, matched, transitions, max_depth, max_state_bytes, complete); errors (state, kind, error)."""

    report: DataFrame
    errors: DataFrame
    exploration: Exploration


def check(
    spark: SparkSession,
    initial: Iterable[bytes],
    successors: Successors,
    deadlocks: bool = True,
    is_end: Callable[[bytes], bool] | None = None,
    asserts: bool = True,
    accepting: Callable[[bytes], bool] | None = None,
    claim: Callable[[bytes], bool] | None = None,
    depth_is_error: bool = False,
    max_errors: int = 1,
    max_depth: int = 10_000,
) -> Check:
    """Checks a model and reports on the search.

    deadlocks: states without a successor that are no end states are errors; asserts: so are successor
    functions that fail (AssertionError or any other exception); claim: so are states that it refuses;
    accepting: so are accepting states on a cycle; depth_is_error: so are states at max_depth with
    something behind them (0: no bound). max_errors of failed successor functions end the search (0: never);
    all errors of what was searched are returned.
    """
    found = explore(spark, initial, successors, max_depth=max_depth or 1_000_000_000, max_errors=(max_errors or None) if asserts else None)
    kinds = [spark.createDataFrame([], "state binary, kind string, error string")]

    def put(states: DataFrame, kind: str, error: Column | None = None) -> None:
        kinds.append(states.select("state", F.lit(kind).alias("kind"), (F.lit(None).cast("string") if error is None else error).alias("error")))

    if deadlocks and found.complete:
        put(found.deadlocks(is_end), "invalid end state")
    if asserts:
        failed = F.col("error").startswith("AssertionError")
        kinds.append(found.errors.select("state", F.when(failed, F.lit("assertion")).otherwise(F.lit("exception")).alias("kind"), "error"))
    if claim is not None:
        put(found.states.filter(~predicate(claim)("state")), "claim")
    if accepting is not None:
        put(found.accepting_cycle_states(accepting), "acceptance cycle")
    if depth_is_error and not found.complete:
        put(found.states.filter(F.col("depth") == max_depth), "depth limit")
    errors = kinds[0]
    for x in kinds[1:]:
        errors = errors.union(x)
    return Check(found.statistics().withColumn("complete", F.lit(found.complete)), errors, found)


def predicate(test: Callable[[bytes], bool]):
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([bool(test(bytes(x))) for x in s], dtype=bool), "boolean")


def whole_of(tables: list[DataFrame], write: bool = True) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.union(x)
    return stored(out, "states") if write else out


def explore(spark: SparkSession, initial: Iterable[bytes], successors: Successors, store: Callable[[bytes], bool] | None = None, max_depth: int = 1_000_000, max_errors: int | None = None) -> Exploration:
    """Breadth-first exploration. Rounds expand the frontier only; a state is new if an anti-join finds it in no earlier round.

    States that `store` refuses are expanded each time they are met in a later round and are not kept.
    An exception in the successor function is an error of that state; after max_errors of them the
    search ends.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s in b.column(0).to_pylist():
                try:
                    out += [(s, None, bytes(n)) for n in successors(s)]
                except Exception as e:  # an error of the model, not of the search
                    out.append((s, f"{type(e).__name__}: {e}", None))
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        a, e, n = zip(*rows, strict=True)
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(e, pa.string()), pa.array(n, pa.binary())], names=["state", "error", "next"])

    first = spark.createDataFrame([(bytes(s),) for s in initial], "state binary").distinct()
    frontier, rows = counted(first.withColumn("depth", F.lit(0)), "states")
    kept, steps, passed, errors, complete = [frontier], [], [], 0, True
    depth = 0
    while rows:
        if depth >= max_depth:
            complete = False
            break
        depth += 1
        step, failed = counted(frontier.select("state").mapInArrow(expand, STEP), "steps", "error is not null")
        steps.append(step)
        errors += failed
        if max_errors is not None and errors >= max_errors:
            complete = False
            break
        visited = kept[0].select("state")
        for x in [*kept[1:], *passed]:
            visited = visited.union(x.select("state"))
        ahead = step.filter("next is not null").select(F.col("next").alias("state")).distinct()
        new, rows = counted(ahead.join(visited, "state", "left_anti").withColumn("depth", F.lit(depth)), "states")
        if not rows:
            break
        if store is None:
            kept.append(new)
        else:
            holds = predicate(store)("state")
            kept.append(stored(new.filter(holds), "states"))
            passed.append(stored(new.filter(~holds), "passed"))
        frontier = new
        if len(kept) > MOST_TABLES:  # a long chain of small tables becomes one
            kept = [whole_of(kept)]
        if len(passed) > MOST_TABLES:
            passed = [whole_of(passed)]
        if len(steps) > MOST_TABLES:
            steps = [whole_of(steps)]
    states, whole = whole_of(kept, False), whole_of(steps, False) if steps else spark.createDataFrame([], STEP)
    transitions = whole.filter("next is not null").select(F.col("state").alias("src"), F.col("next").alias("dst"))
    return Exploration(states, transitions, whole.filter("error is not null").select("state", "error"), complete)
