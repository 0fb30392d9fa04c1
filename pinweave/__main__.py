"""Command line: partition a hypergraph file, or run the cases of a table and report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pinweave.model import PartitionConfig
from pinweave.operators import metrics
from pinweave.operators.projection import ALIASES
from pinweave.plans.engine import partition
from pinweave.plans.harness import run_cases, summary
from pinweave.runtime import Scratch
from pinweave.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pinweave", description=__doc__)
    p.add_argument("hypergraph_file", nargs="?")
    p.add_argument("--hypergraph", "--hypergraph-file", dest="hypergraph")
    p.add_argument("--fixed-file")
    p.add_argument("--hint-file")
    p.add_argument("--output", default="partition.part")
    p.add_argument("--cases", help="run a case table instead")
    d = PartitionConfig()
    for name in ("imb", "num_parts", "eigvecs", "refine_iters", "solver_iters", "best_solns", "ncycles", "seed"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    p.add_argument("--projection-strategy", "--kway-projection", dest="projection", default=d.projection, help=", ".join(sorted(ALIASES)))
    return p


def config(args: argparse.Namespace) -> PartitionConfig:
    return PartitionConfig(num_parts=args.num_parts, imb=args.imb, eigvecs=args.eigvecs, refine_iters=args.refine_iters, solver_iters=args.solver_iters, best_solns=args.best_solns, ncycles=args.ncycles, seed=args.seed, projection=args.projection)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    path = args.hypergraph or args.hypergraph_file
    if not path and not args.cases:
        parser().error("a hypergraph file is needed")
    spark = SparkSession.builder.appName("pinweave").getOrCreate()
    scratch = Scratch(spark, "cli")
    if args.cases:
        runs = run_cases(spark, args.cases)
        files.write_results(runs, args.output, "tsv")
        files.write_results(summary(runs), f"{args.output}.md", "md")
        return 0
    cfg = config(args)
    h = files.read_hypergraph(spark, path, args.fixed_file)
    hint = files.read_labels(spark, args.hint_file) if args.hint_file else None
    found = scratch.keep(partition(h, cfg, scratch, hint), "partition")
    files.write_partition(found, args.output)
    row = metrics.evaluate(h, found, cfg.num_parts).first()
    print(f"cutsize {row['cutsize']} balance {row['balance']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
