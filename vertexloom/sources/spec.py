"""Graphs by a format name and a specification of colon-separated values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..graph import Graph
from . import generators as g
from .petri import PetriNet
from .segments import read_graph


def cut(spec: str, sep: str = ":") -> list[str]:
    """The fields of a specification; empty ones are dropped."""
    return [x for x in spec.split(sep) if x]


def numbers(spec: str, least: int, most: int | None = None) -> list[int]:
    fields = cut(spec)
    if not least <= len(fields) <= (most or least):
        raise g.GraphSpecError(f"{spec!r} has {len(fields)} fields, not {least}" + (f" to {most}" if most else ""))
    try:
        return [int(x) for x in fields]
    except ValueError as e:
        raise g.GraphSpecError(f"{spec!r}: {e}") from e


def fields(spec: str, kinds: tuple[type, ...], default_seed: int = 1) -> list:
    """Fields of the kinds; a last int may be left out and is the seed."""
    found = cut(spec)
    if len(found) == len(kinds) - 1 and kinds[-1] is int:
        found.append(str(default_seed))
    if len(found) != len(kinds):
        raise g.GraphSpecError(f"{spec!r} has {len(found)} fields, not {len(kinds)}")
    try:
        return [k(x) for k, x in zip(kinds, found, strict=True)]
    except ValueError as e:
        raise g.GraphSpecError(f"{spec!r}: {e}") from e


# Leaves of compositions: how many numbers a leaf takes, and its graph.
LEAVES: dict[str, tuple[int, Callable]] = {
    "lattices": (1, lambda s, n: g.lattice(s, n, n, True, True)),
    "lines": (1, g.line),
    "bilines": (1, g.biline),
    "cliques": (1, g.clique),
    "rings": (1, g.ring),
    "birings": (1, g.biring),
    "trees": (2, g.tree),
}

# Shapes of compositions: how many numbers the shape takes, and the composition.
SHAPES: dict[str, tuple[int, Callable]] = {
    "treeof": (1, lambda s, leaf, h: g.tree_of(s, h, leaf)),
    "lineof": (1, lambda s, leaf, m: g.line_of(s, m, leaf)),
    "latticeof": (2, lambda s, leaf, m, n: g.lattice_of(s, m, n, leaf)),
    "latticeloopedof": (2, lambda s, leaf, m, n: g.lattice_of(s, m, n, leaf, True, True)),
    "latticeonerowconnectedof": (2, lambda s, leaf, m, n: g.lattice_of(s, m, n, leaf, False, True, 1, n)),
    "latticeonerowloopedof": (2, lambda s, leaf, m, n: g.lattice_of(s, m, n, leaf, True, False, 1, n)),
}

SIMPLE: dict[str, tuple[int, Callable]] = {
    "line": (1, g.line),
    "biline": (1, g.biline),
    "ring": (1, g.ring),
    "biring": (1, g.biring),
    "clique": (1, g.clique),
    "bintree": (1, lambda s, h: g.tree(s, h, 2)),
    "tree": (2, g.tree),
    "lattice": (2, g.lattice),
    "latticeloopedrows": (2, lambda s, r, c: g.lattice(s, r, c, True, False)),
    "latticeloopedcols": (2, lambda s, r, c: g.lattice(s, r, c, False, True)),
    "latticelooped": (2, lambda s, r, c: g.lattice(s, r, c, True, True)),
    "lmlmtn": (2, g.lmlmtn),
    "limlon": (2, g.limlon),
}

# Laws of degrees: the law's two values come between n and the seed.
LAWS: dict[str, tuple[str, tuple[type, type]]] = {
    "logn": ("lognormal", (float, float)),
    "uniform": ("uniform", (float, float)),
    "discreteuniform": ("discrete", (int, int)),
    "normal": ("normal", (float, float)),
    "pareto": ("pareto", (float, float)),
}


def load_graph(spark: SparkSession, form: str, spec: str, compat: bool = False) -> Graph:
    """The graph of a format ('svcii', 'svc-ii', 'hip', 'parquet': spec is a path) or a generator.

    compat takes specifications as the older tool read them: Uniform and DiscreteUniform change places,
    RandomizedTree is seed:n, LatticeLooped is cols:rows, FastErdos and ApproximateErdos are n:trials:p, and
    ordinary inputs of Petri nets gain when a rule fires.
    """
    name = form.lower()
    if name in ("svcii", "svc-ii", "hip"):
        return read_graph(spark, spec, "hip" if name == "hip" else "svcii")
    if name == "parquet":
        return Graph.load(spark, spec)
    if name in SIMPLE:
        count, make = SIMPLE[name]
        values = numbers(spec, count)
        return make(spark, *(values[::-1] if compat and name == "latticelooped" else values))
    for shape in sorted(SHAPES, key=len, reverse=True):
        leaf = name.removeprefix(shape)
        if name.startswith(shape) and leaf in LEAVES:
            outer, compose = SHAPES[shape]
            inner, make = LEAVES[leaf]
            values = numbers(spec, outer + inner)
            return compose(spark, make(spark, *values[outer:]), *values[:outer])
    if name == "randomizedtree":
        n, seed = numbers(spec, 2)[:: -1 if compat else 1]
        return g.randomized_tree(spark, n, seed)
    if name == "ringwithshortcuts":
        n, m, seed = fields(spec, (int, int, int))
        return g.ring_with_shortcuts(spark, n, m, seed)
    if name == "slowerdos":
        n, p, seed = fields(spec, (int, float, int))
        return g.slow_erdos(spark, n, p / n, seed)
    if name in ("fasterdos", "approximateerdos"):
        if compat:
            n, trials, p, seed = fields(spec, (int, int, float, int))
        else:
            (n, p, seed) = fields(spec, (int, float, int))
            trials, p = n, p / n
        return g.degree_distribution(spark, n, g.Degrees("binomial" if name == "fasterdos" else "nearly binomial", trials, p), seed, distinct=name == "fasterdos")
    if name in LAWS:
        law, kinds = LAWS[name]
        if compat and name in ("uniform", "discreteuniform"):
            law = {"uniform": "discrete", "discrete": "uniform"}[law]
        n, a, b, seed = fields(spec, (int, *kinds, int))
        return g.degree_distribution(spark, n, g.Degrees(law, a, b), seed)
    if name in ("petrinetstatespace", "biopetrinetstatespace"):
        largest, _, path = spec.partition(":")
        lines = [r.value for r in spark.read.text(path).toLocalIterator()]  # a net's rules
        return PetriNet.parse(lines, int(largest), biological=name.startswith("bio"), compat=compat).graph(spark)
    raise g.GraphSpecError(f"unknown format or generator {form!r}")


def names() -> list[str]:
    """Every name that load_graph knows, lower case."""
    composed = [shape + leaf for shape in SHAPES for leaf in LEAVES]
    random = ["randomizedtree", "ringwithshortcuts", "slowerdos", "fasterdos", "approximateerdos", *LAWS]
    return [*SIMPLE, *composed, *random, "petrinetstatespace", "biopetrinetstatespace", "svcii", "svc-ii", "hip", "parquet"]


def load_undirected(spark: SparkSession, form: str, spec: str) -> Graph:
    """The graph with every edge in both directions."""
    return load_graph(spark, form, spec).undirected()


def make_graph(spark: SparkSession, form: str, spec: str, path: str, out: str = "hip", segments: int = 4) -> Graph:
    """Generates a graph and writes it as hip, svcii or parquet."""
    from .segments import write_graph

    name = form.lower()
    if name in ("lmlmbtn", "lmlmotn"):
        m, n = numbers(spec, 2)
        graph = (g.rooted_tree if name == "lmlmbtn" else g.ordered_tree)(spark, m, n)
    elif name == "power":
        n, most, exponent, seed = fields(spec, (int, float, float, int))
        graph = g.degree_distribution(spark, n, g.Degrees("power", most, exponent), seed)
    else:
        graph = load_graph(spark, {"lognorm": "logn", "norm": "normal", "erdos": "slowerdos"}.get(name, form), spec)
    graph = graph.materialized()
    if out == "parquet":
        graph.save(path)
    else:
        write_graph(graph, path, out, segments)
    return graph
