"""State spaces of Petri nets.

Text, a rule a line: `a & ^b -> c & d`; `^` is an input that inhibits, `-|` gives outputs that take away
instead of add. A state is a marking of all places, a number in base (largest value + 1); places are
numbered as they come.

Firing takes one from each ordinary input and moves the outputs. With compat, inputs move like outputs
(ordinary ones gain), as an older tool's state spaces have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decode_radix
from ..graph import Graph

RULE = re.compile(r"\s*(?P<inputs>\^?\w+(?:\s*&\s*\^?\w+)*)\s*-(?P<kind>[>|])\s*(?P<outputs>\w+(?:\s*&\s*\w+)*)\s*")


@dataclass
class Rule:
    """Inputs as (place, inhibits), outputs as places, and whether outputs are taken away."""

    inputs: list[tuple[int, bool]]
    outputs: list[int]
    inhibits: bool


@dataclass
class PetriNet:
    largest: int
    biological: bool = False
    compat: bool = False
    places: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def parse(cls, lines: Iterable[str], largest: int, biological: bool = False, compat: bool = False) -> PetriNet:
        net, numbers = cls(largest, biological, compat), {}

        def place(name: str) -> int:
            if name not in numbers:
                numbers[name] = len(net.places)
                net.places.append(name)
            return numbers[name]

        for number, text in enumerate(lines, 1):
            m = RULE.fullmatch(text)
            if not m:
                raise ValueError(f"line {number} is no rule: {text!r}")
            inputs = [(place(x.lstrip("^")), x.startswith("^")) for x in re.split(r"\s*&\s*", m["inputs"])]
            net.rules.append(Rule(inputs, [place(x) for x in re.split(r"\s*&\s*", m["outputs"])], m["kind"] == "|"))
        return net

    @property
    def base(self) -> int:
        return self.largest + 1

    @property
    def states(self) -> int:
        return self.base ** len(self.places)

    def digit(self, place: int) -> Column:
        return F.floor(F.col("id") / self.base**place).cast("long") % self.base

    def met(self, rule: Rule) -> Column:
        """The rule's inputs hold: marked for ordinary ones, unmarked for inhibitors."""
        return reduce(lambda a, b: a & b, [self.digit(p) == 0 if inhibits else self.digit(p) > 0 for p, inhibits in rule.inputs])

    def fired(self, rule: Rule) -> tuple[Column, Column]:
        """(enabled, next state). In a biological net inputs stay and values are kept in range; else every output must have room."""
        new: dict[int, Column] = {}
        at = lambda p: new.get(p, self.digit(p))
        enabled = self.met(rule)
        if not self.biological:
            for p in rule.outputs:
                enabled = enabled & (self.digit(p) >= 1 if rule.inhibits else self.digit(p) + 1 <= self.largest)
            for p, inhibits in rule.inputs:
                new[p] = self.moved(at(p), inhibits, taken=not self.compat)
        for p in rule.outputs:
            new[p] = self.moved(at(p), rule.inhibits, taken=False)
        return enabled, self.with_digits(new)

    def moved(self, value: Column, inhibits: bool, taken: bool) -> Column:
        """An input of an ordinary arc loses one, one of an inhibitor stays; outputs gain, or lose, one. Values stay in range."""
        if taken:
            return value if inhibits else F.greatest(value - 1, F.lit(0))
        return F.greatest(value - 1, F.lit(0)) if inhibits else F.least(value + 1, F.lit(self.largest))

    def with_digits(self, new: dict[int, Column]) -> Column:
        out = F.col("id")
        for p, value in new.items():
            out = out + (value - self.digit(p)) * self.base**p
        return out

    def decays(self) -> list[tuple[Column, Column]]:
        """Of biological nets: a marked place loses one unless a rule that would fill it has its inputs met."""
        out = []
        for p in range(len(self.places)):
            fed = [self.met(r) for r in self.rules if p in r.outputs and not r.inhibits]
            enabled = self.digit(p) > 0
            for x in fed:
                enabled = enabled & ~x
            out.append((enabled, self.with_digits({p: self.digit(p) - 1})))
        return out

    def graph(self, spark: SparkSession) -> Graph:
        """All markings and, without repeats, the moves between them; loops only in nets that are not biological."""
        moves = [self.fired(r) for r in self.rules] + (self.decays() if self.biological else [])
        states = spark.range(self.states)
        targets = F.array_distinct(F.array_compact(F.array(*[F.when(ok, to) for ok, to in moves]))) if moves else F.array().cast("array<bigint>")
        edges = states.select(F.col("id").alias("src"), F.explode(targets).alias("dst"))
        return Graph(states.select("id"), edges.filter("src <> dst") if self.biological else edges, 0)

    def markings(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """ids with marking: `place=value` of the marked places."""
        digits = decode_radix(F.col(column), self.base, len(self.places))
        names = F.array(*[F.lit(p) for p in self.places])
        named = F.zip_with(names, digits, lambda n, d: F.when(d > 0, F.concat(n, F.lit("="), d.cast("string"))))
        return ids.withColumn("marking", F.array_join(F.array_compact(named), " "))
