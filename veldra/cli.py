"""The commands: ``python -m veldra.cli COMMAND ...``. 0 if all went well, else 1."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veldra.operators import assign, centers, evaluate, kmeans_local, kmeans_parallel, normalize, pivot, sampling, summary
from veldra.plans.scratch import drop_all
from veldra.plans.workflow import sketch_arrays
from veldra.roles import Header, is_numeric, resolve
from veldra.sources import records

#: A sketch starts from this many vectors at most.
MOST_SEEDS = 100_000


class CommandError(Exception):
    """A command that can't be run as given."""


def _shared(p: argparse.ArgumentParser, records_in: bool = False, vectors_in: bool = False, records_out: bool = False, vectors_out: bool = False, centers_in: bool = False, seed: bool = False) -> None:
    p.add_argument("--local", action="store_true")
    p.add_argument("--compress", action="store_true")
    if records_in or vectors_in:
        p.add_argument("--input-paths", required=True)
        p.add_argument("--format", default="text" if records_in else "parquet")
    if records_in:
        p.add_argument("--delim", default=",")
        p.add_argument("--quote-char", default='"')
        p.add_argument("--comment-char")
    if records_out or vectors_out:
        p.add_argument("--output-path", required=True)
        p.add_argument("--output-type", default="csv" if records_out else "parquet")
    if records_out:
        p.add_argument("--csv-delim", default=",")
        p.add_argument("--output-table")
    if vectors_out:
        p.add_argument("--output-key", default="text")
    if centers_in:
        p.add_argument("--centers-file", required=True)
        p.add_argument("--center-ids")
    if seed:
        p.add_argument("--seed", type=int, default=1729)


def _records(spark, a, roles: Header | summary.Summary | None = None) -> DataFrame:
    if roles is None:
        roles = Header.load(a.header_file) if getattr(a, "header_file", None) else summary.Summary.load(a.summary_file) if getattr(a, "summary_file", None) else None
    text = {"delimiter": a.delim, "quote": a.quote_char, "comment": a.comment_char} if a.format.lower() == "text" else {}
    return records.read_records(spark, a.format, a.input_paths, roles, **text)


def _vectors(spark, a) -> DataFrame:
    return records.read_vectors(spark, a.input_paths, a.format)


def _centers(spark, a) -> dict[int, centers.Centers]:
    ids = [int(i) for i in a.center_ids.split(",")] if a.center_ids else None
    return centers.centers_from(spark.read.parquet(a.centers_file), ids)


def _write(df: DataFrame, a) -> None:
    records.write_records(df, a.output_path, a.output_type, a.csv_delim, compress=a.compress, table=a.output_table)


COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, flags: Callable):
    def register(f: Callable) -> Callable:
        COMMANDS[name] = (flags, f)
        return f

    return register


def _header_flags(p):
    _shared(p)
    p.add_argument("--table", required=True)
    p.add_argument("--header-file", required=True)


@command("header", _header_flags)
def header(spark, a):
    """Write a table's column roles."""
    Header.of_schema(records.read_table(spark, a.table).schema).save(a.header_file)


def _summary_flags(p):
    _shared(p, records_in=True)
    p.add_argument("--header-file")
    p.add_argument("--summary-file", required=True)
    p.add_argument("--max-levels", type=int, default=summary.MAX_LEVELS)


@command("summary", _summary_flags)
def summarize(spark, a):
    """Profile the columns of a table."""
    roles = Header.load(a.header_file) if a.header_file else None
    df = records.read_records(spark, a.format, a.input_paths, roles, **({"delimiter": a.delim, "quote": a.quote_char, "comment": a.comment_char} if a.format.lower() == "text" else {}))
    summary.summarize(df, roles, max_levels=a.max_levels).save(a.summary_file)


def _normalize_flags(p):
    _shared(p, records_in=True, vectors_out=True)
    p.add_argument("--id-column")
    p.add_argument("--sparse", action="store_true")
    p.add_argument("--summary-file")
    p.add_argument("--transform", default="none")


@command("normalize", _normalize_flags)
def normalize_(spark, a):
    """Turn records into vectors."""
    s = summary.Summary.load(a.summary_file) if a.summary_file else summary.Summary()
    df = _records(spark, a)
    id_column = resolve(df.columns, a.id_column)[0] if a.id_column else None
    seen = Observation("normalize")
    records.write_vectors(normalize.normalize(df, s, id_column, a.transform, dropped=seen), a.output_path, a.output_type, a.output_key, a.sparse, a.compress)
    counts = seen.get
    if counts["missing_number"] or counts["unknown_level"]:
        print(f"of {counts['rows']} rows {counts['missing_number']} have a missing number and {counts['unknown_level']} an unknown level; they are dropped", file=sys.stderr)


def _pivot_flags(p):
    _shared(p, records_in=True, records_out=True)
    for f in ("--summary-file", "--header-file", "--var-levels"):
        p.add_argument(f)
    for f in ("--id-fields", "--value-fields", "--var-field"):
        p.add_argument(f, required=True)
    p.add_argument("--aggregation", default="sum")


@command("pivot", _pivot_flags)
def pivot_(spark, a):
    """Long records to wide ones."""
    df = _records(spark, a)
    attribute = resolve(df.columns, a.var_field)[0]
    if not a.var_levels and not a.summary_file:
        raise CommandError("give the levels or a summary file")
    levels = a.var_levels.split(",") if a.var_levels else summary.Summary.load(a.summary_file)
    _write(pivot.pivot_wide(df, resolve(df.columns, a.id_fields), attribute, resolve(df.columns, a.value_fields), levels, a.aggregation), a)


def _sample_flags(p):
    _shared(p, records_in=True, records_out=True, seed=True)
    p.add_argument("--size", type=int, default=0)
    p.add_argument("--prob", type=float, default=0.0)
    p.add_argument("--header-file")
    p.add_argument("--group-fields")
    p.add_argument("--weight-field")
    p.add_argument("--weight-invert", action="store_true")
    p.add_argument("--weight-default", type=float, default=0.0)


@command("sample", _sample_flags)
def sample(spark, a):
    """A sample of records: of a size, by weight, per group, or by probability."""
    if (a.size > 0) == (a.prob > 0):
        raise CommandError("give either a size or a probability")
    lines = a.format.lower() == "text" and not a.header_file
    if lines and (a.group_fields or a.weight_field):
        raise CommandError("groups and weights need a header file")
    df = records.read_lines(spark, a.input_paths, a.comment_char) if lines else _records(spark, a)
    if a.prob:
        out = sampling.bernoulli_sample(df, a.prob, None, a.seed)
    else:
        weight = None
        if a.weight_field:
            name = resolve(df.columns, a.weight_field)[0]
            if not is_numeric(df.schema[name].dataType):
                raise CommandError(f"{name} is not numeric")
            weight = sampling.clean_weight(df[name], a.weight_invert, a.weight_default)
        if a.group_fields:
            out = sampling.grouped_sample(df, a.size, resolve(df.columns, a.group_fields), None, weight, a.seed)
        elif weight is not None:
            out = sampling.weighted_sample(df, a.size, None, weight, a.seed)
        else:
            out = sampling.uniform_sample(df, a.size, None, a.seed)
    if lines and a.output_type.lower() == "csv":
        records.write_records(out, a.output_path, "csv", a.csv_delim, exact=True, compress=a.compress, table=a.output_table)
    else:
        _write(out, a)


def _showvec_flags(p):
    _shared(p, vectors_in=True)
    p.add_argument("--count", type=int, default=20)


@command("showvec", _showvec_flags)
def showvec(spark, a):
    """Print some vectors."""
    for r in records.first_vectors(_vectors(spark, a), a.count).collect():
        print(r.id, r.features)


def _seeds(spark, a) -> list[list[float]]:
    """The first vectors, which come to the driver as part of the sketch: at most ``MOST_SEEDS``."""
    found = records.read_vectors(spark, a.init_vectors_path, a.format).select("features").distinct().limit(MOST_SEEDS + 1).collect()
    if len(found) > MOST_SEEDS:
        raise CommandError(f"more than {MOST_SEEDS} different first vectors")
    return sorted(list(r.features) for r in found)


def _ksketch_flags(p):
    _shared(p, vectors_in=True, seed=True)
    p.add_argument("--init-vectors-path")
    p.add_argument("--cross-folds", type=int, default=2)
    p.add_argument("--iterations", type=int, default=5)
    p.add_argument("--points-per-iteration", type=int, required=True)
    p.add_argument("--output-file", required=True)
    p.add_argument("--index-bits", type=int, default=128)
    p.add_argument("--index-samples", type=int, default=32)


@command("ksketch", _ksketch_flags)
def ksketch(spark, a):
    """A weighted sketch of the vectors for each fold."""
    seeds = _seeds(spark, a) if a.init_vectors_path else None
    points = kmeans_parallel.sketch(_vectors(spark, a), a.iterations, a.points_per_iteration, a.cross_folds, seeds, a.seed, True, bits=a.index_bits, candidates=a.index_samples)
    points.write.mode("overwrite").parquet(a.output_file)


def _kmeans_flags(p):
    _shared(p, seed=True)
    p.add_argument("--input-file", required=True)
    p.add_argument("--clusters", required=True)
    p.add_argument("--best-of", type=int, default=5)
    p.add_argument("--init-strategy", default="plus_plus")
    p.add_argument("--max-iterations", type=int, default=100)
    p.add_argument("--mini-batch-size", type=int, default=0)
    p.add_argument("--centers-file", required=True)
    p.add_argument("--num-threads", type=int, default=4)
    p.add_argument("--eval-details-file")
    p.add_argument("--eval-stats-file", default="kmeans_stats.csv")


@command("kmeans", _kmeans_flags)
def kmeans(spark, a):
    """Clusterings of a sketch, and their stability on its last fold."""
    points = spark.read.parquet(a.input_file)
    folds = sorted(r[0] for r in points.select("fold").distinct().collect())
    ks = [int(k) for k in a.clusters.split(",")]
    update = kmeans_local.mini_batch(a.max_iterations, a.mini_batch_size) if a.mini_batch_size else kmeans_local.lloyds(a.max_iterations)
    how = {"best_of": a.best_of, "seed": a.seed, "threads": a.num_threads, "init": a.init_strategy, "update": update}
    x, w = sketch_arrays(points)
    runs = kmeans_local.grid(x, w, ks, **how)
    centers.centers_table(spark, dict(enumerate(runs))).write.mode("overwrite").parquet(a.centers_file)
    if len(folds) > 1:
        train, test = sketch_arrays(points, folds[:-1]), sketch_arrays(points, folds[-1:])
        stats, details = [], []
        for i, (t, r) in enumerate(zip(kmeans_local.grid(*test, ks, **how), kmeans_local.grid(*train, ks, **how))):
            one, rows = evaluate.evaluate_sketch(t, r, *test, i)
            stats.append(one)
            details += rows
        text = evaluate.stats_csv(stats)
        print(text, end="")
        Path(a.eval_stats_file).write_text(text)
        if a.eval_details_file:
            with Path(a.eval_details_file).open("a") as out:
                out.write(evaluate.details_csv(details, header=out.tell() == 0))


def _lloyds_flags(p):
    _shared(p, vectors_in=True, centers_in=True)
    p.add_argument("--output-centers-file", required=True)
    p.add_argument("--num-iterations", type=int, default=1)
    p.add_argument("--approx", action="store_true")
    p.add_argument("--compute-costs", action="store_true")


@command("lloyds", _lloyds_flags)
def lloyds(spark, a):
    """Lloyd's rounds over all vectors."""
    vectors = _vectors(spark, a)
    moved = kmeans_parallel.lloyds(vectors, _centers(spark, a), a.num_iterations, a.approx)
    centers.centers_table(spark, moved).write.mode("overwrite").parquet(a.output_centers_file)
    if a.compute_costs:
        print("CenterId,Cost")
        for r in assign.costs(vectors, moved, a.approx).orderBy("cluster_id").collect():
            print(f"{r.cluster_id},{r.cost:.4f}")


@command("kassign", lambda p: _shared(p, vectors_in=True, centers_in=True, records_out=True))
def kassign(spark, a):
    """Assign vectors to their nearest centers."""
    _write(assign.assign(_vectors(spark, a), _centers(spark, a)), a)


def _kcovar_flags(p):
    _shared(p, vectors_in=True, centers_in=True)
    p.add_argument("--output-file", required=True)
    p.add_argument("--approx", action="store_true")


@command("kcovar", _kcovar_flags)
def kcovar(spark, a):
    """Covariances of clusters."""
    assign.cluster_covariances(_vectors(spark, a), _centers(spark, a), a.approx).write.mode("overwrite").parquet(a.output_file)


def _koutlier_flags(p):
    _shared(p, vectors_in=True, centers_in=True, records_out=True)
    p.add_argument("--covariance-file", required=True)
    p.add_argument("--approx", action="store_true")


@command("koutlier", _koutlier_flags)
def koutlier(spark, a):
    """Squared Mahalanobis distances of vectors from their clusters."""
    _write(assign.outliers(_vectors(spark, a), _centers(spark, a), spark.read.parquet(a.covariance_file), a.approx), a)


def usage() -> str:
    return "Commands:\n" + "".join(f"  {n:10} {f.__doc__}\n" for n, (_, f) in COMMANDS.items())


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if args[:1] == ["help"]:
        for name in args[1:]:
            if name in COMMANDS:
                p = argparse.ArgumentParser(name)
                COMMANDS[name][0](p)
                p.print_help()
        print(usage() if len(args) == 1 else "", end="")
        return 0
    if not args or args[0] not in COMMANDS:
        print(usage(), file=sys.stderr)
        return 1
    flags, run = COMMANDS[args[0]]
    parser = argparse.ArgumentParser(args[0], description=run.__doc__)
    flags(parser)
    try:
        a = parser.parse_args(args[1:])
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    own = spark is None
    if own:
        builder = SparkSession.builder.appName(f"veldra {args[0]}")
        spark = (builder.master("local[*]") if a.local else builder).getOrCreate()
    try:
        run(spark, a)
    except CommandError as e:
        print(f"Command Error: {e}", file=sys.stderr)
        return 1
    except ValueError as e:
        print(f"Argument Error: {e}", file=sys.stderr)
        return 1
    finally:
        if own:  # all results are written
            drop_all(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
