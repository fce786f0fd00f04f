"""Tables to feature vectors by a summary: one projection, no shuffle but for columns of very many levels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veldra.functions.transforms import Transform, level_index, transform_named
from veldra.operators.summary import Summary, as_number


#: Levels of a column that are looked up in a literal; more are looked up by a join.
LITERAL_LEVELS = 1000


def normalize(df: DataFrame, summary: Summary, id_column: str | None = None, transform: str | Transform = "none", sparse: bool = False, dropped: Observation | None = None) -> DataFrame:
    """``id`` (string, empty without an id column) and ``features``.

    Columns keep their order: a numeric one gives one transformed element, a categorical one a cell
    for each level in order, columns without statistics nothing; columns that the summary doesn't
    know pass raw. A field's own transform and scale go before the given ones. Rows with a missing
    number or an unknown or null level are dropped. An empty table gives no rows. ``sparse`` gives
    the storage form with indices instead of an array; only its non-zero elements are made.
    ``dropped`` observes ``rows``, ``missing_number`` and ``unknown_level`` (a row may have both).
    """
    by_name = {f.name or f"c{i}": f for i, f in enumerate(summary.fields)}
    kinds = dict(df.dtypes)
    names = {c: f"__n{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[df[c].alias(n) for c, n in names.items()])
    parts: list[tuple] = []  # (size, level place or None, value)
    numbers, known = F.lit(True), F.lit(True)
    for c, n in names.items():
        f = by_name.get(c)
        if c == id_column or (f is not None and f.is_empty):
            continue
        if f is None:
            parts.append((1, None, rows[n].try_cast("double") if kinds[c] == "string" else rows[n].cast("double")))
        elif f.numeric:
            x = as_number(rows, n)
            numbers = numbers & x.isNotNull()
            parts.append((1, None, transform_named(f.numeric.transform or transform)(x, f.numeric) * f.scale))
        else:
            levels, place = f.levels, f"{n}_at"
            if len(levels) > LITERAL_LEVELS:
                table = df.sparkSession.createDataFrame(pa.table({f"{n}_level": pa.array(levels, pa.string()), place: pa.array(range(len(levels)), pa.int32())}))
                rows = rows.join(table, F.col(n).cast("string") == F.col(f"{n}_level"), "left").drop(f"{n}_level")
            else:
                rows = rows.withColumn(place, level_index(F.col(n).cast("string"), levels) if levels else F.lit(None).cast("int"))
            known = known & F.col(place).isNotNull()
            parts.append((len(levels), place, F.lit(float(f.scale))))
    if dropped is not None:
        rows = rows.observe(dropped, F.count("*").alias("rows"), F.count_if(~numbers).alias("missing_number"), F.count_if(~known).alias("unknown_level"))
    kept = rows.where(numbers & known)
    name = F.col(names[id_column]).cast("string") if id_column else F.lit("")
    return kept.select(name.alias("id"), (_sparse(parts, name) if sparse else _dense(parts)).alias("features"))


def _dense(parts: list[tuple]) -> Column:
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    cells = [F.array(v) if at is None else F.concat(zeros(F.col(at)), F.array(v), zeros(F.lit(size - 1) - F.col(at))) for size, at, v in parts]
    return F.concat(*cells) if cells else F.array().cast("array<double>")


def _sparse(parts: list[tuple], name: Column) -> Column:
    """size, values, indices, id of the non-zero elements, straight from places and values."""
    begin, cells = 0, []
    for size, at, v in parts:
        cells.append(F.struct((F.lit(begin) if at is None else F.lit(begin) + F.col(at)).cast("int").alias("i"), v.alias("v")))
        begin += size
    every = F.array(*cells) if cells else F.array().cast("array<struct<i:int,v:double>>")
    held = F.filter(every, lambda c: c["v"].isNull() | (c["v"] != 0))
    return F.struct(F.lit(begin).alias("size"), F.transform(held, lambda c: c["v"]).alias("values"), F.transform(held, lambda c: c["i"]).alias("indices"), name.cast("string").alias("id"))
