"""Strict load of comma-separated lines: typed valid rows, and the failing ones with the reason.

The load keeps each row's offset (``row_id``) and takes only lines that conform. What was loaded is
subtracted from the raw offsets by an anti-join, and only that remainder is diagnosed.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.plans.scratch import Scratch

#: The 42 columns of the files in order.
COLUMNS = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in "
    "num_compromised root_shell su_attempted num_root num_file_creations num_shells num_access_files num_outbound_cmds "
    "is_host_login is_guest_login conn_count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate "
    "same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate "
    "dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate "
    "dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate category"
).split()
SYMBOLIC = ("protocol_type", "service", "flag", "land", "logged_in", "is_host_login", "is_guest_login", "category")
FLAGS = ("land", "logged_in", "is_host_login", "is_guest_login")
PROTOCOLS = ("icmp", "tcp", "udp")

#: One field: quoted with doubled quotes within, or free of quotes. Possessive, so that no line makes the matcher go back.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_LINE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+$"
_NUMBER = r"[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"


def line_of(raw: Column) -> Column:
    """The line without a byte order mark at the start and white space at the end."""
    last = F.substring(raw, -1, 1)
    plain = last.between("!", "~") & ~raw.startswith("\ufeff")  # nothing to take off
    return F.when(plain, raw).otherwise(F.regexp_replace(raw, r"(?U)^\x{FEFF}|\s++$", ""))


def carries_data(line: Column) -> Column:
    """False for null and empty lines and comments; they neither load nor fail."""
    return F.coalesce((line != "") & ~line.startswith("#"), F.lit(False))


def fields_of(line: Column) -> Column:
    """The fields of a line with sound quoting, unquoted."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({_FIELD})"), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s++|\s++$", "")


def number_of(field: Column) -> Column:
    """A valid continuous field as double; null where it is empty or NA."""
    return F.coalesce(field.try_cast("double"), _trim(field).try_cast("double"))


def _joined_fit(f: Column, at: Sequence[int], most: float) -> Column:
    """Whether the fields at ``at`` are all numbers from 0 to ``most``, finite, or missing.

    One pattern over all of them, joined: a field that holds a comma makes too many of them.
    """
    if not at:
        return F.lit(True)
    joined = F.concat_ws(",", *[f[i] for i in at])
    one = rf"\s*+(?:NA|{_NUMBER})?+\s*+"
    numbers = F.transform(F.split(F.regexp_replace(joined, r"(?U)\s++", ""), ","), lambda x: x.try_cast("double"))
    in_range = (F.coalesce(F.array_min(numbers), F.lit(0.0)) >= 0) & (F.coalesce(F.array_max(numbers), F.lit(0.0)) <= most)
    return F.when(joined.rlike(rf"(?U)^{one}(?:,{one}){{{len(at) - 1}}}$"), in_range).otherwise(False)


def _plain_pattern(columns: Sequence[str]) -> str:
    """A pattern of lines that conform at sight: no quotes, short plain numbers, rates from 0 to 1."""
    number, rate = r"(?:NA|[0-9]{1,18}+(?:\.[0-9]{0,18}+)?+)?+", r"(?:NA|0(?:\.[0-9]{0,18}+)?+|1(?:\.0{0,18}+)?+)?+"

    def one(c: str) -> str:
        if c == "protocol_type":
            return f"(?:{'|'.join(PROTOCOLS)})"
        if c in FLAGS:
            return "[01]"
        return '[^",]++' if c in SYMBOLIC else rate if c.endswith("_rate") else number

    return "^" + ",".join(one(c) for c in columns) + "$"


def conforms(line: Column, columns: Sequence[str]) -> Column:
    """Whether a line has sound quoting, as many fields as ``columns`` and valid values.

    Most lines conform at sight; the fields of the others are taken apart.
    """
    parsed = F.when(line.rlike(_LINE), _parsed(line, columns)["fits"]).otherwise(False)
    return F.when(line.rlike(_plain_pattern(columns)), True).otherwise(parsed)


def values_fit(f: Column, columns: Sequence[str] = COLUMNS) -> Column:
    """Whether every field of an array of as many fields as ``columns`` has a valid value."""
    numbers = [i for i, c in enumerate(columns) if c not in SYMBOLIC]
    ok = F.lit(True)
    for i, c in enumerate(columns):
        if c == "protocol_type":
            ok = ok & f[i].isin(*PROTOCOLS)
        elif c in FLAGS:
            ok = ok & f[i].isin("0", "1")
        elif c in SYMBOLIC:
            ok = ok & (f[i] != "")
    plain, rates = [i for i in numbers if not columns[i].endswith("_rate")], [i for i in numbers if columns[i].endswith("_rate")]
    return ok & _joined_fit(f, plain, sys.float_info.max) & _joined_fit(f, rates, 1.0)


def _parsed(line: Column, columns: Sequence[str]) -> Column:
    """n, fits, f of a line with sound quoting. The fields are bound once, not copied into every use."""
    one = lambda f: F.struct(F.size(f).alias("n"), F.when(F.size(f) == len(columns), values_fit(f, columns)).otherwise(False).alias("fits"), f.alias("f"))
    return F.transform(F.array(fields_of(line)), one)[0]


def load_valid(raw: DataFrame, row_id: str = "row_id", line: str = "raw_line", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The conforming rows, typed: ``row_id`` and ``columns`` (continuous ones double, others string).

    Empty and ``NA`` continuous fields load as null. Other columns of ``raw``, whatever their names,
    don't come out. Null and empty lines and comments don't load; an empty table gives no rows.
    """
    return _typed(_conforming(raw, row_id, line, columns), row_id, columns)


def _conforming(raw: DataFrame, row_id: str, line: str, columns: Sequence[str]) -> DataFrame:
    """``__id``, ``__line`` of the conforming rows."""
    lines = raw.select(F.col(row_id).alias("__id"), line_of(F.col(line)).alias("__line")).where(carries_data(F.col("__line")))
    return lines.where(conforms(F.col("__line"), columns))


def _typed(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    f = F.col("__f")
    return rows.select("__id", fields_of(F.col("__line")).alias("__f")).select(F.col("__id").alias(row_id), *[(f[i] if c in SYMBOLIC else number_of(f[i])).alias(c) for i, c in enumerate(columns)])


def _remainder(raw: DataFrame, loaded: DataFrame, row_id: str, line: str, scratch: Scratch) -> DataFrame:
    """``__id``, ``__raw`` of the rows that weren't loaded.

    Offsets alone are subtracted; only the lines of what is left are fetched. The result is written,
    since the optimizer would otherwise push the diagnosis below the joins, onto every row.
    """
    left = raw.select(F.col(row_id).alias("__id")).join(loaded, "__id", "left_anti")
    lines = raw.select(F.col(row_id).alias("__id"), F.col(line).alias("__raw"))
    fetched = lines.join(left, "__id", "left_semi").unionByName(lines.where("__id is null"))
    return scratch.put(fetched, "remainder")


def _diagnosed(rest: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    lines = rest.select("__id", line_of(F.col("__raw")).alias("__line")).where(carries_data(F.col("__line")))
    sound = F.col("__line").rlike(_LINE)
    judged = lines.select("__id", F.when(sound, _parsed(F.col("__line"), columns)).alias("__p"))
    reason = F.when(F.col("__p").isNull(), "quoting").when(F.col("__p.n") != len(columns), "column_count").when(~F.col("__p.fits"), "invalid_value")
    return judged.select(F.col("__id").alias(row_id), reason.alias("reason")).where("reason is not null")


def failing_rows(raw: DataFrame, row_id: str = "row_id", line: str = "raw_line", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """``row_id`` and ``reason`` of each failing row: the first of ``quoting``, ``column_count``, ``invalid_value``.

    ``row_id`` must be unique; a row whose ``row_id`` is null is never subtracted by the anti-join
    but is diagnosed all the same, so it comes out exactly if it fails. A line of any length is
    handled whole. Rows that load are parsed once; the diagnosis reads the remainder only.
    """
    loaded = _conforming(raw, row_id, line, columns).select("__id")
    return _diagnosed(_remainder(raw, loaded, row_id, line, Scratch(raw.sparkSession, "strict")), row_id, columns)


def load_report(raw: DataFrame, row_id: str = "row_id", line: str = "raw_line", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """``reason``, ``n_rows`` of all rows: loaded, skipped and each reason of failure; reasons without rows don't come out."""
    scratch = Scratch(raw.sparkSession, "report")
    loaded = scratch.put(_conforming(raw, row_id, line, columns).select("__id"), "loaded")
    failed = _diagnosed(_remainder(raw, loaded, row_id, line, scratch), row_id, columns)
    skipped = raw.where(~carries_data(line_of(F.col(line)))).select(F.lit("skipped").alias("reason"))
    parts = skipped.unionByName(loaded.select(F.lit("loaded").alias("reason"))).unionByName(failed.select("reason"))
    return parts.groupBy("reason").agg(F.count("*").alias("n_rows"))
