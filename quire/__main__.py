"""Command line: ``python -m quire convert|inspect|validate|batch``.

Each command returns 0 if all is well, 2 if checks found errors, 1 if a package could not be read. What a command
prints is one line of totals and the packages that failed, at most SHOWN of them; tables stay with the executors.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ConversionConfig, MobileProfile
from quire.operators.order import STRATEGIES
from quire.shipping import ship
from quire.sources import packages
from quire.streaming.events import Progress, log_listener

SHOWN = 20


def _profile(args: argparse.Namespace) -> MobileProfile:
    return MobileProfile(page_width=args.page_width, page_height=args.page_height, margin=args.margin, body_font_px=args.body_font, min_font_px=args.min_font, paginated=args.paginated)


def _profile_options() -> argparse.ArgumentParser:
    p, default = argparse.ArgumentParser(add_help=False), MobileProfile()
    p.add_argument("--page-width", type=int, default=default.page_width)
    p.add_argument("--page-height", type=int, default=default.page_height)
    p.add_argument("--paginated", action="store_true", default=True)
    p.add_argument("--fixed-height", dest="paginated", action="store_false")
    p.add_argument("--body-font", type=float, default=default.body_font_px)
    p.add_argument("--min-font", type=float, default=default.min_font_px)
    p.add_argument("--margin", type=int, default=default.margin)
    return p


def parser() -> argparse.ArgumentParser:
    shared = _profile_options()
    p = argparse.ArgumentParser(prog="quire", description=__doc__.partition("\n")[0])
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert", parents=[shared], help="convert one package: a file, or a folder with one in it")
    c.add_argument("input")
    c.add_argument("--out", required=True)
    c.add_argument("--strategy", choices=sorted(STRATEGIES), default="auto")
    c.add_argument("--no-fonts", action="store_true")
    c.add_argument("--verbose", "-v", action="store_true")
    i = commands.add_parser("inspect", help="what is in a package")
    i.add_argument("input")
    i.add_argument("--json", action="store_true")
    v = commands.add_parser("validate", parents=[shared], help="check what a conversion wrote")
    v.add_argument("input")
    b = commands.add_parser("batch", parents=[shared], help="convert every package below a folder, in one job")
    b.add_argument("input")
    b.add_argument("--out", required=True)
    return p


def _totals(codes: DataFrame) -> int:
    """Print how many packages have each return code and the first that failed; the worst code, 1 if there is none."""
    counts = {r.rc: r.n for r in codes.groupBy("rc").agg(F.count("*").alias("n")).collect()}
    print(f"{counts.get(0, 0)} passed, {counts.get(2, 0)} with errors, {counts.get(1, 0)} not read")
    for r in codes.where("rc <> 0").orderBy("rc", "doc_id").limit(SHOWN).collect():
        print(f"  {r.doc_id}: {r.rc}")
    return max(counts, default=1)


def _chosen(spark: SparkSession, path: str) -> str | None:
    """The package that ``path`` names: itself, or the first of the shallowest folder that has one."""
    if path.endswith(".idml"):
        return path
    first = packages.nearest_packages(packages.listing(spark, path)).agg(F.min("path").alias("path")).first()
    return first.path


def _run(spark: SparkSession, source: str, out: str, config: ConversionConfig, verbose: bool) -> int:
    from quire.operators import qa
    from quire.plans import convert

    progress = Progress()
    progress.attach(log_listener())
    if verbose:
        progress.attach(lambda e: print(f"[{e['stage']}] {e['message']}", file=sys.stderr))
    parts = packages.unpack(spark, source)
    result = convert.convert(parts, config, convert.package_links(spark, source), progress=progress)
    files = convert.write(result, out, [source], progress, config.profile)
    return _totals(convert.return_codes(parts, qa.report([result.qa, files])))


def _convert(spark: SparkSession, args: argparse.Namespace) -> int:
    source = _chosen(spark, args.input)
    if source is None:
        print("no package found")
        return 1
    return _run(spark, source, args.out, ConversionConfig(profile=_profile(args), reading_order=args.strategy, embed_fonts=not args.no_fonts), args.verbose)


def _batch(spark: SparkSession, args: argparse.Namespace) -> int:
    return _run(spark, args.input, args.out, ConversionConfig(profile=_profile(args)), False)


def _inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    from quire.plans import convert

    source = _chosen(spark, args.input)
    row = convert.inspect(packages.unpack(spark, source)).first() if source else None
    if row is None:
        print("no package found")
        return 1
    print(json.dumps(row.asDict()) if args.json else "\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
    return 0


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    from quire.operators import qa
    from quire.plans import convert

    report = convert.validate(spark, args.input)
    checked = qa.profile_checks(report.select("doc_id").distinct(), _profile(args))
    return _totals(convert.return_codes(None, report.unionByName(checked)))


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {"convert": _convert, "inspect": _inspect, "validate": _validate, "batch": _batch}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return COMMANDS[args.command](ship(spark or SparkSession.builder.appName("quire").getOrCreate()), args)


if __name__ == "__main__":
    sys.exit(main())
