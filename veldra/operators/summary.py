"""Column profiles: numeric statistics, level histograms, missing values; kept as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldra.roles import Header, is_numeric

MAX_LEVELS = 1_000_000


@dataclass
class Numeric:
    min: float
    max: float
    mean: float
    std_dev: float
    missing: int = 0
    transform: str | None = None


@dataclass
class FieldStats:
    """A field's numeric statistics or histogram; neither for a skipped field."""

    name: str | None
    numeric: Numeric | None = None
    histogram: dict[str, int] | None = None
    trimmed: bool = False
    scale: float = 1.0

    @property
    def levels(self) -> list[str]:
        return sorted(self.histogram or {})

    @property
    def is_empty(self) -> bool:
        return self.numeric is None and self.histogram is None


@dataclass
class Summary:
    fields: list[FieldStats] = field(default_factory=list)
    record_count: int = 0
    field_count: int = 0

    def __getitem__(self, name: str) -> FieldStats:
        return next(f for f in self.fields if f.name == name)

    def has_stats(self, name: str) -> bool:
        return any(f.name == name and not f.is_empty for f in self.fields)

    @property
    def ignored(self) -> list[str]:
        return [f.name for f in self.fields if f.is_empty]

    def net_levels(self) -> int:
        """Levels of all categorical fields, less one for each."""
        return sum(len(f.histogram) - 1 for f in self.fields if f.histogram)

    def header(self) -> Header:
        names = [f.name or f"c{i}" for i, f in enumerate(self.fields)]
        return Header(names, ["numeric" if f.numeric else "symbolic" if f.histogram is not None else "ignored" for f in self.fields])

    def to_json(self) -> str:
        def entry(f: FieldStats) -> dict:
            out: dict = {} if f.name is None else {"name": f.name}
            if f.numeric:
                n = f.numeric
                out["numeric"] = {"min": n.min, "max": n.max, "mean": n.mean, "stdDev": n.std_dev}
                out["numeric"] |= ({"missing": n.missing} if n.missing else {}) | ({"transform": n.transform} if n.transform else {})
            if f.histogram is not None:
                out["histogram"] = {k: {"count": f.histogram[k]} for k in f.levels}
                out |= {"trimmed": True} if f.trimmed else {}
            return out | ({"scale": f.scale} if f.scale != 1.0 else {})

        return json.dumps({"stats": [entry(f) for f in self.fields], "recordCount": self.record_count, "fieldCount": self.field_count}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Summary:
        raw, fields = json.loads(text), []
        for e in raw.get("stats", []):
            n, h = e.get("numeric"), e.get("histogram")
            fields.append(
                FieldStats(
                    e.get("name"),
                    n and Numeric(n["min"], n["max"], n["mean"], n["stdDev"], n.get("missing") or 0, n.get("transform")),
                    {k: v["count"] for k, v in h.items()} if h is not None else None,
                    bool(e.get("trimmed")),
                    float(e.get("scale") or 1.0),
                )
            )
        return cls(fields, raw.get("recordCount", 0), raw.get("fieldCount", 0))

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load(cls, path: str) -> Summary:
        return cls.from_json(Path(path).read_text())

    @classmethod
    def of_levels(cls, name: str, levels: list[str]) -> Summary:
        """A summary of one categorical field with given levels."""
        return cls([FieldStats(name, histogram=dict.fromkeys(levels, 0))], 0, 1)


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double; what is no number, NaN too, is null."""
    x = df[name].try_cast("double") if dict(df.dtypes)[name] == "string" else df[name].cast("double")
    return F.when(~F.isnan(x), x)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: ``field``, ``min``, ``max``, ``mean``, ``std_dev`` (population), ``missing``, ``n``.

    Null, NaN and unparsable values are missing. A column without a value has zeros; so has every
    column of an empty table. One pass, one aggregation row per task.
    """
    pieces = []
    for i, c in enumerate(columns):
        x = as_number(df, c)
        zero = lambda a: F.coalesce(a, F.lit(0.0))
        pieces.append(F.struct(F.lit(c).alias("field"), zero(F.min(x)).alias("min"), zero(F.max(x)).alias("max"), zero(F.avg(x)).alias("mean"), zero(F.stddev_pop(x)).alias("std_dev"), (F.count("*") - F.count(x)).alias("missing"), F.count("*").alias("n")).alias(f"p{i}"))
    wide = df.agg(*pieces)
    return wide.select(F.explode(F.array(*[f"p{i}" for i in range(len(columns))])).alias("p")).select("p.*")


def level_counts(df: DataFrame, columns: list[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """``field``, ``level``, ``n``: the first ``max_levels`` levels of each column in order, with exact counts.

    Null is no level. A level that is the whole of a hot column is a row per task before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), df[c].cast("string").alias("level")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).where("p.level is not null").groupBy("p.field", "p.level").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("level"))
    return counts.withColumn("r", rank).where(F.col("r") <= max_levels).drop("r")


def summarize(df: DataFrame, header: Header | None = None, symbolic: list[str] | None = None, ignored: list[str] = (), default_symbolic: bool = False, max_levels: int = MAX_LEVELS) -> Summary:
    """The profile of a table. Without a header, columns that aren't numbers are symbolic.

    ``symbolic`` names the symbolic columns instead (the numeric ones if ``default_symbolic``).
    """
    if header:
        symbolic, ignored = header.columns("symbolic"), header.columns("ignored", "id")
    elif symbolic is None:
        symbolic = [f.name for f in df.schema if not is_numeric(f.dataType)]
    elif default_symbolic:
        symbolic = [c for c in df.columns if c not in symbolic]
    used = [c for c in df.columns if c not in ignored]
    numbers, words = [c for c in used if c not in symbolic], [c for c in used if c in symbolic]
    stats: dict[str, FieldStats] = {c: FieldStats(c) for c in df.columns}
    if numbers:
        for r in numeric_profile(df, numbers).collect():
            stats[r.field].numeric = Numeric(r.min, r.max, r.mean, r.std_dev, r.missing)
            total = r.n
    else:
        total = df.count()
    for c in words:
        stats[c].histogram = {}
    if words:
        for r in level_counts(df, words, max_levels).collect():
            stats[r.field].histogram[r.level] = r.n
        for c in words:
            stats[c].trimmed = len(stats[c].histogram) >= max_levels
    return Summary([stats[c] for c in df.columns], total, len(used))
