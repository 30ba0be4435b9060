"""An algebra of condition cubes: axes of several attributes, wildcards, lists, and cubes brought together.

A cube is a description and holds no data. An axis has cells; a cell says for each of the axis's
attributes which values belong to it, a list or anything at all. A trial is in the conditions whose
cells on every axis hold its values, if it passes the cube's filters.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anything, a missing value too.
ANY = None

Cell = tuple[tuple[Hashable, ...] | None, ...]


def _listed(values: object) -> tuple[Hashable, ...] | None:
    if values is ANY:
        return None
    return tuple(values) if isinstance(values, (list, tuple, set, frozenset)) else (values,)


@dataclass(frozen=True)
class Axis:
    """attributes and cells; in a cell there is for each attribute a tuple of values or ANY."""

    attributes: tuple[str, ...]
    cells: tuple[Cell, ...]

    @staticmethod
    def of(attributes: str | Iterable[str], cells: Iterable) -> Axis:
        """Cells as values, lists of values or ANY for one attribute; as dictionaries by attribute for several."""
        names = (attributes,) if isinstance(attributes, str) else tuple(attributes)
        out = [tuple(_listed(c.get(n, ANY)) for n in names) if isinstance(c, dict) else (_listed(c),) for c in cells]
        return Axis(names, tuple(out))

    def widened(self, attributes: Iterable[str], filters: dict[str, tuple]) -> Axis:
        """With more attributes, in which each cell holds what the filters allow, or anything."""
        new = [a for a in attributes if a not in self.attributes]
        return Axis((*self.attributes, *new), tuple((*c, *(filters.get(a) for a in new)) for c in self.cells))


@dataclass(frozen=True)
class Cube:
    """axes, the first running fastest, and filters: values that a trial's attributes must be among."""

    axes: tuple[Axis, ...] = ()
    filters: dict[str, tuple] = field(default_factory=dict)

    def filtered(self, **values: object) -> Cube:
        return replace(self, filters=self.filters | {a: _listed(v) for a, v in values.items()})

    def by(self, attributes: str | Iterable[str], cells: Iterable) -> Cube:
        """With one axis more."""
        return replace(self, axes=(*self.axes, Axis.of(attributes, cells)))

    def by_values(self, trials: DataFrame, *attributes: str, occupied: bool = True) -> Cube:
        """With one axis more whose cells are fixed now: the values of attributes that trials (as far as they
        pass the filters) hold, in order and missing ones last; of several attributes the combinations
        that occur, or all with occupied=False. Values of an attribute are few."""
        rows = trials.where(self.passes())
        if occupied:
            cells = [tuple(r) for r in rows.select(*attributes).distinct().collect()]
        else:
            cells = list(product(*[[r[0] for r in rows.select(a).distinct().collect()] for a in attributes]))
        cells.sort(key=lambda c: [(x is None, x if x is not None else 0) for x in reversed(c)])
        return replace(self, axes=(*self.axes, Axis(tuple(attributes), tuple(tuple((x,) for x in c) for c in cells))))

    def __mul__(self, other: Cube) -> Cube:
        """All combinations of both cubes' conditions, this one's running faster; an attribute can be on the
        axes of one of them only, and both filters hold."""
        shared = set(self.attributes) & set(other.attributes)
        if shared:
            raise ValueError(f"both cubes have {', '.join(sorted(shared))} on an axis")
        both = dict(self.filters)
        for a, values in other.filters.items():
            mine = both.get(a)
            both[a] = values if mine is None else mine if values is None else tuple(v for v in mine if v in values)
        return Cube(self.axes + other.axes, both)

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(a for x in self.axes for a in x.attributes)

    def conditions(self) -> list[dict[str, tuple | None]]:
        """What each condition allows of each attribute, in order of its number."""
        out = []
        for cells in product(*[x.cells for x in reversed(self.axes)]):
            out.append({a: v for x, c in zip(reversed(self.axes), cells, strict=True) for a, v in zip(x.attributes, c, strict=True)})
        return out

    def passes(self) -> Column:
        return _all(_among(F.col(a), v) for a, v in self.filters.items())

    def members(self, trials: DataFrame) -> DataFrame:
        """trial_id, cond of the trials in each condition; a trial may be in several or in none."""
        rows, index, size = trials.where(self.passes()), F.lit(0), 1
        for n, axis in enumerate(self.axes):
            hits = [F.when(_all(_among(F.col(a), v) for a, v in zip(axis.attributes, c, strict=True)), F.lit(i)) for i, c in enumerate(axis.cells)]
            rows = rows.withColumn(f"_axis{n}", F.explode(F.filter(F.array(*hits), lambda i: i.isNotNull())))
            index = index + F.col(f"_axis{n}") * size
            size *= len(axis.cells)
        return rows.select("trial_id", index.cast("int").alias("cond"))

    def occupied(self, trials: DataFrame) -> list[int]:
        """The numbers of the conditions that hold a trial."""
        return sorted(r.cond for r in self.members(trials).select("cond").distinct().collect())  # conditions, not trials

    def table(self, spark) -> DataFrame:
        """cond and a column of text for each attribute: its values joined by |, * for anything."""
        text = lambda v: "*" if v is None else "|".join("" if x is None else str(x) for x in v)
        rows = [(i, *[text(c[a]) for a in self.attributes]) for i, c in enumerate(self.conditions())]
        return spark.createDataFrame(rows, ", ".join(["cond int", *[f"`{a}` string" for a in self.attributes]]))


def _among(x: Column, values: tuple | None) -> Column:
    if values is None:
        return F.lit(True)
    known = [v for v in values if v is not None]
    hit = x.isin(known) if known else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | x.isNull() if None in values else F.coalesce(hit, F.lit(False))


def _all(parts: Iterable[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def expand_to_match(cubes: list[Cube]) -> list[Cube]:
    """The cubes with the same axes, conditions as many as before and holding the same trials.

    Axes are the first cube's; an axis of a later one whose attributes all lie on one of them adds
    none, one that shares attributes with a single axis adds the rest to that, one that shares none
    is a new axis. Where a cube lacks an attribute its cells hold what its filter says, or
    anything. An axis whose attributes lie on several axes is an error.
    """
    axes: list[list[str]] = []
    for c in cubes:
        for axis in c.axes:
            mine = set(axis.attributes)
            near = [x for x in axes if mine & set(x)]
            if any(mine <= set(x) for x in near):
                continue
            if len(near) > 1:
                raise ValueError(f"the attributes {', '.join(axis.attributes)} of one axis lie on several axes of another cube")
            if near:
                near[0] += [a for a in axis.attributes if a not in near[0]]
            else:
                axes.append(list(axis.attributes))
    out = []
    for c in cubes:
        new = []
        for names in axes:
            mine = [x for x in c.axes if set(x.attributes) & set(names)]
            if len(mine) > 1:
                raise ValueError(f"the attributes {', '.join(names)} of one axis lie on several axes of another cube")
            axis = (mine[0] if mine else Axis((), ((),))).widened(names, c.filters)
            order = [axis.attributes.index(a) for a in names]
            new.append(Axis(tuple(names), tuple(tuple(cell[i] for i in order) for cell in axis.cells)))
        out.append(replace(c, axes=tuple(new)))
    return out


def matches(a: Cube, b: Cube) -> list[tuple[int, int]]:
    """(cond of a, cond of b): pairs that agree on all attributes of both, lists as sets and anything
    with everything; an attribute that one of them does not have does not count."""
    agree = lambda x, y: x is None or y is None or set(x) == set(y)
    shared = [n for n in a.attributes if n in b.attributes]
    theirs = b.conditions()
    return [(i, j) for i, x in enumerate(a.conditions()) for j, y in enumerate(theirs) if all(agree(x[n], y[n]) for n in shared)]


def matched_difference(a: Cube, means_a: DataFrame, b: Cube, means_b: DataFrame) -> DataFrame:
    """cond, other, diff, sem: each condition of a less those of b that it matches; means are (cond, mean,
    sem) of each cube, errors add in quadrature."""
    pairs = means_a.sparkSession.createDataFrame(matches(a, b), "cond int, other int")
    y = means_b.select(F.col("cond").alias("other"), F.col("mean").alias("_m"), F.col("sem").alias("_s"))
    rows = pairs.join(means_a.select("cond", "mean", "sem"), "cond").join(y, "other")
    return rows.select("cond", "other", (F.col("mean") - F.col("_m")).alias("diff"), F.sqrt(F.col("sem") * F.col("sem") + F.col("_s") * F.col("_s")).alias("sem"))
