"""Channels: what there is, what their names say, and changes to their values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channels(events: DataFrame, pattern: str | None = None, kind: str = "event") -> DataFrame:
    """channel, kind, n of the event channels, optionally those whose names match."""
    rows = events if pattern is None else events.where(F.col("event").rlike(pattern))
    return rows.groupBy(F.col("event").alias("channel")).agg(F.count("*").alias("n")).select("channel", F.lit(kind).alias("kind"), "n")


def parse_names(df: DataFrame, column: str = "name") -> DataFrame:
    """array, electrode and unit of names like array12_3; NULL where a name has another form."""
    part = lambda i: F.nullif(F.regexp_extract(column, r"^([A-Za-z]+)(\d+)_(\d+)$", i), F.lit(""))
    return df.withColumns({"array": part(1), "electrode": part(2).cast("long"), "unit": part(3).cast("long")})


def sub_channel(df: DataFrame, name: str) -> Column:
    """The channel that name says: a column, or group(5), the fifth place of an array column. Names that
    the table does not have are errors."""
    m = re.fullmatch(r"(\w+)(?:\((\d+)\))?", name)
    kinds = dict(df.dtypes)
    if not m or m[1] not in kinds:
        raise KeyError(f"no channel {name}")
    if m[2] is None:
        return F.col(m[1])
    if not kinds[m[1]].startswith("array"):
        raise KeyError(f"{m[1]} is no group of channels")
    return F.get(m[1], F.lit(int(m[2]) - 1)).alias(name)


def scale(x: Column, source: tuple[float, float], target: tuple[float, float]) -> Column:
    """The affine map that takes the limits of source to those of target."""
    k = (target[1] - target[0]) / (source[1] - source[0])
    return (x - F.lit(source[1])) * F.lit(k) + F.lit(target[1])


def relabel(df: DataFrame, names: dict[str, str], column: str = "unit") -> DataFrame:
    """Values of column by a small mapping; others stay."""
    if not names:
        return df
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(mapping, F.col(column)), F.col(column)))


def masked_update(df: DataFrame, column: str, new: Column, mask: Column, clear: bool = False) -> DataFrame:
    """column takes new where mask holds; elsewhere it stays, or is cleared."""
    keep = F.lit(None) if clear else F.col(column)
    return df.withColumn(column, F.when(F.coalesce(mask, F.lit(False)), new).otherwise(keep))


def infer(df: DataFrame) -> DataFrame:
    """channel, kind, element of a table's columns: params hold one value a row, series an array
    of numbers, groups an array of arrays, events are arrays whose names say so."""
    rows = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("array<array"):
            rows.append((f.name, "group", kind[12:-2]))
        elif kind.startswith("array<"):
            named = f.name.lower().endswith(("times", "onset", "start", "end", "events"))
            rows.append((f.name, "event" if named else "series", kind[6:-1]))
        else:
            rows.append((f.name, "param", kind))
    return df.sparkSession.createDataFrame(rows, "channel string, kind string, element string")


def conform(df: DataFrame, schema: dict[str, str], required: set[str]) -> DataFrame:
    """The columns of schema with their types: optional ones that lack are missing values, values
    that cannot be cast become missing; a required column that lacks raises ValueError."""
    lacking = sorted(required - set(df.columns))
    if lacking:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    return df.select(*[F.col(c).try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def in_order(df: DataFrame, times: str, values: str) -> DataFrame:
    """Both arrays of every row sorted by time."""
    pairs = F.array_sort(F.zip_with(times, values, lambda t, v: F.struct(t.alias("t"), v.alias("v"))))
    return df.withColumn("_p", pairs).withColumns({times: F.col("_p.t"), values: F.col("_p.v")}).drop("_p")


def changed(df: DataFrame, add: dict[str, Column] | None = None, copy: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """df with channels copied (new: old), added, renamed (old: new) and dropped, in this order."""
    out = df.withColumns({new: F.col(old) for new, old in (copy or {}).items()})
    out = out.withColumns(add or {}).withColumnsRenamed(rename or {})
    return out.drop(*(drop or []))


def stored_times(values: DataFrame, aligned: DataFrame, column: str = "t") -> DataFrame:
    """values(trial_id, ..) with times that are relative to each trial's zero turned into the trial's own."""
    return values.join(aligned.where("valid").select("trial_id", "zero"), "trial_id").withColumn(column, F.col(column) + F.col("zero")).drop("zero")


def described(df: DataFrame, notes: dict[str, dict]) -> DataFrame:
    """df whose columns carry notes (units, kind ..) as metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata=notes[c]) if c in notes else F.col(c) for c in df.columns])


def descriptions(df: DataFrame, keys: list[str]) -> DataFrame:
    """channel and a column for each key of the notes that the columns of df carry."""
    rows = [(f.name, *[None if k not in f.metadata else str(f.metadata[k]) for k in keys]) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, ", ".join(["channel string", *[f"`{k}` string" for k in keys]]))


def common_prefix(df: DataFrame, column: str) -> DataFrame:
    """prefix: what all values of a column begin with, which is what the first and the last have in common."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    at = F.sequence(F.lit(1), F.least(F.length("a"), F.length("b")))
    same = F.filter(at, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i))
    n = F.when(F.least(F.length("a"), F.length("b")) > 0, F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)
    return ends.select(F.substring("a", F.lit(1), n).alias("prefix"))


class VirtualChannels:
    """Channels that are computed when they are asked for, from others or from one another."""

    def __init__(self) -> None:
        self._made: dict[str, tuple[Column, list[str]]] = {}

    def define(self, name: str, value: Column, needs: list[str] | None = None) -> VirtualChannels:
        """value may be any column expression, a pandas UDF among them; needs names the virtual channels in it."""
        for other in needs or []:
            if other not in self._made:
                raise ValueError(f"{name} needs {other}, which is not defined")
        self._made[name] = (value, list(needs or []))
        return self

    def read(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the named channels and no other virtual ones."""
        wanted: set[str] = set()
        todo = [n for n in names if n in self._made]
        while todo:
            n = todo.pop()
            if n not in wanted:
                wanted.add(n)
                todo += self._made[n][1]
        out = df
        for n, (value, _) in self._made.items():  # definitions come after what they need
            out = out.withColumn(n, value) if n in wanted else out
        return out.drop(*[n for n in wanted if n not in names])
