"""What sources reach, found over a contracted graph: long ways cost no round for every few edges.

Where more than `few` edges are left, components within ranges of ids become one vertex (above `block`
edges), and chains become one edge; a source is never inside a chain. What is reached of the smaller graph
tells what is reached of the whole one, so the result is the same for any bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .components import FINISH, depth_first, reach_set
from .contract import BLOCK, WORTH, Chains, Ranges, passing
from .iterate import counted


def reached(edges: DataFrame, sources: DataFrame, few: int = FINISH, block: int = BLOCK) -> DataFrame:
    """(id): what any source (id) reaches, itself included. Null ends and sources are left out."""
    edges, rows = counted(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    at = stored(sources.filter("id is not null").select(F.col("id").cast("long").alias("id")).distinct(), "sources")
    levels: list[Chains | Ranges] = []
    while rows > few:
        before = rows
        if rows > block:
            ranges = Ranges(edges, rows, block, depth_first)
            if ranges.found:
                at = stored(at.join(ranges.places, "id", "left").select(F.coalesce("to", "id").alias("id")).distinct(), "sources")
                levels.append(ranges)
                edges, rows = ranges.edges, ranges.rows
        if rows > few:
            passes, many = counted(passing(edges).join(at, "id", "left_anti"), "passes")
            if many * WORTH >= rows:
                chains = Chains(edges, passes)
                levels.append(chains)
                edges, rows = chains.edges, chains.rows
        if (before - rows) * WORTH < before:
            break
    found = reach_set(edges, at, block)
    for level in reversed(levels):
        found = stored(level.reached(found), "reached")
    return found
