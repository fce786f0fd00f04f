"""Queries of the general problems: heavy keys (2) and rows that fail to parse (4)."""

from __future__ import annotations

from veldra.catalog import Catalog, table
from veldra.operators.dense_sums import heavy_keys, key_sums
from veldra.sources.strict_csv import COLUMNS, FLAGS, SYMBOLIC, failing_rows, load_report, load_valid

CATALOG = Catalog()
_KEYS = ["field_name", "level_name"]

_SUMS = """SELECT field_name, level_name, count(*) AS n_rows, CAST(sum(level_count) AS DECIMAL(38,0)) AS value_sum
FROM summary_histogram GROUP BY 1, 2"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'


def _valid_sql() -> str:
    parts = []
    for i, c in enumerate(COLUMNS, 1):
        if c == "protocol_type":
            parts.append(f"f[{i}] IN ('icmp','tcp','udp')")
        elif c in FLAGS:
            parts.append(f"f[{i}] IN ('0','1')")
        elif c in SYMBOLIC:
            parts.append(f"f[{i}] <> ''")
        else:
            x, most = f"trim(f[{i}], E' \\t\\r\\n')", "<= 1" if c.endswith("_rate") else "< CAST('inf' AS DOUBLE)"
            parts.append(f"({x} IN ('', 'NA') OR (regexp_full_match({x}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast({x} AS DOUBLE) >= 0 AND try_cast({x} AS DOUBLE) {most}, FALSE)))")
    return " AND ".join(parts)


_FIELDS_SQL = rf"""WITH l AS (SELECT row_id, regexp_replace(regexp_replace(raw_line, '^\x{{FEFF}}', ''), '\s+$', '') AS line FROM raw_rows),
s AS (SELECT row_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') AS sound FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
p AS (SELECT row_id, sound, CASE WHEN sound THEN list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1),
  lambda x: CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM s)
"""


@CATALOG.query(f"WITH k AS ({_SUMS}) SELECT field_name, level_name FROM k WHERE field_name IS NOT NULL AND level_name IS NOT NULL AND n_rows * 50 >= (SELECT count(*) FROM summary_histogram)")
def p2_found(spark, folder):
    """Keys of summary_histogram that hold at least a fiftieth of all rows."""
    return heavy_keys(table(spark, folder, "summary_histogram"), _KEYS, "level_count", 50).select(*_KEYS)


@CATALOG.query(f"SELECT field_name, level_name, n_rows, CAST(value_sum AS VARCHAR) AS value_sum FROM ({_SUMS})")
def p2_key_sums(spark, folder):
    """Rows and the exact sum of level_count (as text, since it may pass 64 bits) of every key."""
    sums = key_sums(table(spark, folder, "summary_histogram"), _KEYS, "level_count")
    return sums.withColumn("value_sum", sums.value_sum.cast("string"))


@CATALOG.query(f"SELECT field_name, level_name, n_rows, CAST(value_sum AS VARCHAR) AS value_sum FROM ({_SUMS})")
def p2_key_sums_local(spark, folder):
    """The same by the splits' own dictionaries, as when the keys are too many to send to all tasks."""
    sums = key_sums(table(spark, folder, "summary_histogram"), _KEYS, "level_count", dictionary_bytes=0)
    return sums.withColumn("value_sum", sums.value_sum.cast("string"))


@CATALOG.query(_FIELDS_SQL + f"""SELECT row_id, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> {len(COLUMNS)} THEN 'column_count' ELSE 'invalid_value' END AS reason
FROM p WHERE NOT sound OR len(f) <> {len(COLUMNS)} OR NOT ({_valid_sql()})""")
def p4_found(spark, folder):
    """Failing rows of raw_rows with the first reason."""
    return failing_rows(table(spark, folder, "raw_rows"))


@CATALOG.query(_FIELDS_SQL + f"""SELECT row_id, {", ".join(f"f[{i}] AS {c}" if c in SYMBOLIC else f"try_cast(trim(f[{i}], E' \\t\\r\\n') AS DOUBLE) AS {c}" for i, c in enumerate(COLUMNS, 1))}
FROM p WHERE sound AND len(f) = {len(COLUMNS)} AND ({_valid_sql()})""")
def p4_loaded(spark, folder):
    """The valid rows, typed."""
    return load_valid(table(spark, folder, "raw_rows"))


@CATALOG.query(_FIELDS_SQL + f"""SELECT reason, count(*) AS n_rows FROM (SELECT 'skipped' AS reason FROM l WHERE coalesce(line = '' OR starts_with(line, '#'), TRUE)
UNION ALL SELECT CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> {len(COLUMNS)} THEN 'column_count' WHEN ({_valid_sql()}) THEN 'loaded' ELSE 'invalid_value' END FROM p) GROUP BY 1""")
def p4_report(spark, folder):
    """How many rows loaded, were skipped, or failed for each reason."""
    return load_report(table(spark, folder, "raw_rows"))
