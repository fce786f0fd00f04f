import pytest

from veldra.plans.scratch import Scratch
from veldra.sources.strict_csv import COLUMNS, SYMBOLIC, failing_rows, load_report, load_valid

BASE = [("tcp" if c == "protocol_type" else "0" if c in ("land", "logged_in", "is_host_login", "is_guest_login") else "x" if c in SYMBOLIC else "0") for c in COLUMNS]


def line(**values):
    return ",".join(values.get(c, v) for c, v in zip(COLUMNS, BASE))


GOOD = {
    "plain": line(), "quoted": line(service='"a, ""b"""'), "bom": "﻿" + line(), "tail": line() + " \t\r", "missing": line(duration="NA", src_bytes=""), "spaces": line(duration="\t 5 "),
    "numbers": line(duration="+1.5e2", src_bytes=".5", dst_bytes="0.", hot="1e3", serror_rate="1"), "minus zero": line(duration="-0"), "quoted number": line(duration='"7"'), "unicode space": line(duration=" 3"), "long": line(service="y" * 200_000),
}
BAD = {
    "quoting": [line(service='"open'), line(service='"a"b'), line(service='a"b'), line() + '"s"', line(service='"' + "z" * 100_000)],
    "column_count": ["0", line() + ",", ",".join(BASE[:-1]), line(service="a,b"), line() + "," + line()],
    "invalid_value": [line(duration=x) for x in ("-1", "1e999", "nan", "inf", "1_000", "3 4", "0x1F", "１２", "1e", "+-2", "na", '"1,2"')] + [line(serror_rate="1.01"), line(protocol_type="TCP"), line(protocol_type=" tcp"), line(land="2"), line(flag=""), line(category="")],
}
SKIPPED = [None, "", "# note", '# "open', "﻿# x", "   ", "﻿"]


def frame(spark, lines):
    return spark.createDataFrame([(i, "f", i, l, "extra") for i, l in enumerate(lines)], "row_id bigint, file_name string, line_no int, raw_line string, duration string")


@pytest.mark.parametrize("reason", BAD)
def test_first_reason(spark, reason):
    got = failing_rows(frame(spark, BAD[reason])).collect()
    assert {r.row_id: r.reason for r in got} == dict.fromkeys(range(len(BAD[reason])), reason)


def test_valid_and_skipped_rows_do_not_fail_and_valid_ones_load_typed(spark):
    lines = [*GOOD.values(), *SKIPPED]
    assert failing_rows(frame(spark, lines)).count() == 0
    loaded = {r.row_id: r for r in load_valid(frame(spark, lines)).collect()}
    at = {n: loaded[i] for i, n in enumerate(GOOD)}
    assert len(loaded) == len(GOOD)
    assert at["quoted"].service == 'a, "b"' and at["numbers"].duration == 150.0 and at["numbers"].src_bytes == 0.5
    assert at["missing"].duration is None and at["spaces"].duration == 5.0 and at["quoted number"].duration == 7.0 and at["unicode space"].duration == 3.0


def test_null_ids_are_diagnosed_and_rows_may_repeat(spark):
    df = spark.createDataFrame([(None, line()), (None, "0"), (1, line()), (1, line())], "row_id bigint, raw_line string")
    assert [(r.row_id, r.reason) for r in failing_rows(df).collect()] == [(None, "column_count")]
    assert load_valid(df).count() == 3


def test_empty_table_and_report(spark):
    assert failing_rows(frame(spark, ["x"]).limit(0)).count() == 0 and load_valid(frame(spark, ["x"]).limit(0)).count() == 0
    got = {r.reason: r.n_rows for r in load_report(frame(spark, [line(), line(), "", "0", 'a"'])).collect()}
    assert got == {"loaded": 2, "skipped": 1, "column_count": 1, "quoting": 1}


def test_only_the_remainder_is_diagnosed(spark, monkeypatch):
    """The plan before the remainder judges quoting once, in the load; the diagnosis reads the remainder alone."""
    plans, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or put(self, df, name))
    judged = failing_rows(frame(spark, [line(), "0", 'a"', ""]))
    assert len(plans) == 1 and plans[0].count("LeftAnti") == 1 and plans[0].count("RLIKE ^(?:") == 0
    offsets, loaded = plans[0].split("LeftAnti")[1].split("Relation" if "Relation" in plans[0] else "LogicalRDD", 1)
    assert "RLIKE" not in offsets and "RLIKE" in loaded
    after = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in after and "__raw" in after
    assert {r.row_id: r.reason for r in judged.collect()} == {1: "column_count", 2: "quoting"}


def test_a_remainder_as_large_as_the_table(spark):
    df = frame(spark, [line()] * 3 + ["0"] * 500)
    assert failing_rows(df).count() == 500 and load_valid(df).count() == 3
