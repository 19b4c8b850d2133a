"""Strongest first, keep apart: the greedy choice of hits, without all hits of a key in one task."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue import lineage

#: Blocks are this many gaps wide in the first round and twice as wide in each further one, up to the second number.
FIRST_SPAN, LAST_SPAN = 64, 1 << 16
OPEN, TAKEN = 0, 1


class Block:
    """Decisions inside one block, hits coming strongest first.

    A hit near a taken one is out.  A hit near a stronger undecided one stays
    undecided; so does a guest (a hit of the next block), whose other side is out
    of sight.  Everything else is taken.
    """

    def __init__(self) -> None:
        self.taken: list[float] = []
        self.unsure: list[float] = []

    @staticmethod
    def _near(places: list[float], at: float, gap: float) -> bool:
        i = bisect_left(places, at)
        return (i < len(places) and abs(places[i] - at) < gap) or (i > 0 and abs(places[i - 1] - at) < gap)

    def decide(self, at: float, gap: float, own: bool) -> int | None:
        """TAKEN, OPEN, or None for a hit that is out."""
        if self._near(self.taken, at, gap):
            return None
        if not own or self._near(self.unsure, at, gap):
            insort(self.unsure, at)
            return OPEN
        insort(self.taken, at)
        return TAKEN


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, taken first, strength): those still in, with their state, of the own block only."""
    current, block = None, Block()
    for batch in batches:
        names = batch.schema.names
        key, at, gap, state, number, own = (batch.column(names.index(n)).to_pylist() for n in ("key", "at", "gap", "state", "block", "own"))
        kept, states = [], []
        for i, where in enumerate(zip(key, number)):
            if where != current:
                current, block = where, Block()
            if state[i] == TAKEN:
                insort(block.taken, at[i])
                decision: int | None = TAKEN
            else:
                decision = block.decide(at[i], gap[i], own[i])
            if own[i] and decision is not None:
                kept.append(i)
                states.append(decision)
        out = batch.take(pa.array(kept, pa.int64())).drop_columns(["block", "own"])
        yield out.set_column(out.schema.names.index("state"), "state", pa.array(states, pa.int32()))


def strongest_apart(hits: DataFrame, key: str, at: str, gap: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The hits a greedy pass takes: strongest first, each at least ``gap`` from all taken before it.

    ``order`` names numeric columns, larger first; ``gap`` is one number a key.  Returns
    key, ``at``, the order columns and ``keep``.  Same rows as the greedy pass of a whole key:
    in every round a block decides what no hit outside can change; neighbours see
    each other's edges, and blocks move and widen from round to round until nothing is open.
    A task holds the positions of one block, and the rounds are few: hits that hang on each other
    over more than a block are rare, and each round reaches twice as far.
    """
    names = [*order, *keep]
    state = hits.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(gap).cast("double").alias("gap"),
                        F.lit(OPEN).alias("state"), *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    strength = [F.desc(f"v{i}") for i in range(len(order))]
    schema, turn = state.schema, 0
    while True:
        width = F.col("gap") * min(FIRST_SPAN << turn, LAST_SPAN)
        place = F.col("at") / width + (0.5 if turn % 2 else 0.0)
        block, inside, edge = F.floor(place), place - F.floor(place), (F.col("gap") / width) * (1 + 1e-6)
        seats = F.array_compact(F.array(
            F.struct(block.alias("block"), F.lit(True).alias("own")),
            F.when(inside <= edge, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
            F.when(inside >= 1.0 - edge, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
        seen = state.withColumn("seat", F.explode(seats)).select(*schema.names, "seat.block", "seat.own")
        sorted_ = seen.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("state"), *strength)
        state = lineage.cut(sorted_.mapInArrow(_decided, schema))
        turn += 1
        if state.where(F.col("state") == OPEN).isEmpty():
            return state.select(F.col("key").alias(key), F.col("at").alias(at), *[F.col(f"v{i}").alias(n) for i, n in enumerate(names) if n != at])
