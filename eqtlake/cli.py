"""Command line: ``python -m eqtlake``.

Sources are binary files (``--beqtl-summary``) or a Parquet store that ``--index``
made (``--besd-index``). Arguments are validated before anything is opened.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .dataset import Dataset
from .functions.regions import Region, parse_regions, split_ids
from .operators import queries as q
from .operators import summary
from .sinks import write_report_file

# What is printed after a report, for scripts that read it.
WRITTEN = """Results written to {out}.txt
  Associations (before filter): {n_all}
  Associations (after p-value filter < {p}): {n_below}"""

SIDES = ("snp", "probe")
UNITS = ("kb", "bp")


class UsageError(Exception):
    """Arguments that do not go together; the message is for the user."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eqtlake", description="Query eQTL summary statistics with Spark")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--beqtl-summary", help="prefix of .besd/.esi/.epi files")
    source.add_argument("--besd-index", help="folder of a Parquet store")
    p.add_argument("--index", help="write a Parquet store of --beqtl-summary to this folder and stop")
    p.add_argument("--query", type=float, default=0.05, help="keep rows with a p-value below this")
    for side in SIDES:
        p.add_argument(f"--{side}-chr", help=f"chromosome of the {side} region")
        for end in ("from", "to"):
            p.add_argument(f"--{end}-{side}-kb", type=float)
            p.add_argument(f"--{end}-{side}-bp", type=int)
        p.add_argument(f"--{side}-chrpos", help="chr:pos or chr:start-end in base pairs, comma-separated")
    p.add_argument("--snp", help="SNP ids, comma-separated")
    p.add_argument("--probe", help="probe ids, comma-separated")
    p.add_argument("--gene", help="genes, comma-separated")
    p.add_argument("--out", help="prefix of the report; .txt is added")
    return p


def _bounds(args: argparse.Namespace, side: str) -> list:
    return [getattr(args, f"{end}_{side}_{unit}") for end in ("from", "to") for unit in UNITS]


def _has_region(args: argparse.Namespace, side: str) -> bool:
    named = getattr(args, f"{side}_chr") or getattr(args, f"{side}_chrpos")
    return bool(named) or any(x is not None for x in _bounds(args, side))


def _region_list(args: argparse.Namespace, side: str) -> list[Region]:
    text = getattr(args, f"{side}_chrpos")
    if not text:
        return []
    if getattr(args, f"{side}_chr") or any(x is not None for x in _bounds(args, side)):
        raise UsageError(f"--{side}-chrpos excludes --{side}-chr and single bounds of that side")
    try:
        return parse_regions(text)
    except ValueError as e:
        raise UsageError(f"--{side}-chrpos: {e}") from None


def _single_region(args: argparse.Namespace, side: str) -> Region:
    """One region from chromosome and bounds, each in kb or bp."""
    bp = []
    for end in ("from", "to"):
        kb, whole = (getattr(args, f"{end}_{side}_{unit}") for unit in UNITS)
        if kb is not None and whole is not None:
            raise UsageError(f"--{end}-{side} is given in kb and in bp")
        if kb is None and whole is None:
            raise UsageError(f"the {side} region lacks --{end}-{side}-kb or --{end}-{side}-bp")
        bp.append(whole if whole is not None else Region.from_kb("", kb, kb).start)
    chrom = getattr(args, f"{side}_chr")
    if not chrom:
        raise UsageError(f"the {side} region lacks --{side}-chr")
    return Region(chrom, *bp)


def plan(args: argparse.Namespace) -> tuple[str, list]:
    """The kind of query and its arguments, or ``UsageError``."""
    if args.index:
        if not args.beqtl_summary:
            raise UsageError("--index needs --beqtl-summary")
        return "index", []
    if not args.out:
        raise UsageError("a query needs --out")
    ids = [k for k in ("snp", "probe", "gene") if getattr(args, k)]
    if len(ids) > 1:
        raise UsageError("mutually exclusive options: " + ", ".join(f"--{k}" for k in ids))
    regions = [side for side in SIDES if _has_region(args, side)]
    if ids and regions:
        raise UsageError("Cannot combine --snp/--probe/--gene with regions")
    if ids:
        return ids[0], split_ids(getattr(args, ids[0]))
    if len(regions) < 2:
        raise UsageError("a window needs a SNP region and a probe region")
    lists = [_region_list(args, side) for side in SIDES]
    if any(lists):
        if not all(lists):
            raise UsageError("--snp-chrpos and --probe-chrpos go together")
        return "cis", lists
    return "cis", [[_single_region(args, side)] for side in SIDES]


def select(ds: Dataset, kind: str, wanted: list) -> DataFrame:
    if kind == "cis":
        return q.cis_windows(ds, *wanted, ordered=True)
    return {"snp": q.by_snp, "probe": q.by_probe, "gene": q.by_gene}[kind](ds, wanted, ordered=True)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    kind, wanted = plan(args)
    if kind == "index":
        Dataset.from_files(spark, args.beqtl_summary).save(args.index, by_snp=True)
        print(f"Index created: {args.index}")
        return
    ds = Dataset.from_index(spark, args.besd_index) if args.besd_index else Dataset.from_files(spark, args.beqtl_summary)
    found = select(ds, kind, wanted).cache()
    try:
        if kind != "cis":
            column = {"snp": "snp_id", "probe": "probe_id", "gene": "gene"}[kind]
            times = {x: wanted.count(x) for x in wanted}
            for r in summary.id_counts(found, wanted, column, times).orderBy("pos").collect():
                print(f"  {r.id}: {r.n} associations")
        counts = summary.threshold_counts(found, args.query).first()
        print(f"\nFound {counts.n_all} associations")
        if counts.n_all:
            write_report_file(found, args.out, args.query)
            print(WRITTEN.format(out=args.out, p=args.query, n_all=counts.n_all, n_below=counts.n_below))
    finally:
        found.unpersist()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        plan(args)
        run(spark or SparkSession.builder.appName("eqtlake").getOrCreate(), args)
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
