"""Message rounds: one join along the edges, one aggregation by receiver, one join back.

Edges with a null end and messages to ids that are no vertices are lost; null vertices keep their state. Parallel edges
carry a message each. An empty state stays empty. Names that start with `__` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_round(state: DataFrame, edges: DataFrame, send: Column, merge: Column, apply: dict[str, Column], active: Column | None = None) -> DataFrame:
    """The next state table.

    state: (id, ...); edges: (src, dst, ...), without common names. `send` is an expression over the sender's state and the
    edge, named `msg` at the receiver; `merge` aggregates `msg`; `apply` gives new columns over the old
    ones and `merged` (null where nothing was received). Receivers' partial aggregates are combined
    before the shuffle.
    """
    senders = state if active is None else state.filter(active)
    messages = senders.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("__to"), send.alias("msg"))
    merged = messages.groupBy("__to").agg(merge.alias("merged"))
    joined = state.join(merged, F.col("id") == F.col("__to"), "left")
    return joined.select("id", *[apply.get(c, F.col(c)).alias(c) for c in state.columns if c != "id"])


def pregel(state: DataFrame, edges: DataFrame, send: Column, merge: Column, apply: dict[str, Column], rounds: int, active: Column | None = None, store_every: int = 5) -> DataFrame:
    """A fixed number of message rounds."""
    from ..storage import stored

    for number in range(1, rounds + 1):
        state = message_round(state, edges, send, merge, apply, active)
        if number % store_every == 0 and number < rounds:
            state = stored(state, "pregel")
    return state
