"""Command line: check, check-file, sanity, infer, marker failed, schema validate, sample extract, sample summarise, generate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gaugeline.operators import markers, schema as sch
from gaugeline.plans import feeds
from gaugeline.sources import generate, text, views


VERSION = "2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeline")
    p.add_argument("--version", action="version", version=f"gaugeline: {VERSION}")
    p.add_argument("--dry-run", action="store_true", help="print what would be done")
    sub = p.add_subparsers(dest="command", required=True)

    def checks(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("-s", "--separator", default="|", type=text.check_separator)
        c.add_argument("--file-format", default="delimited-text", choices=text.FORMATS)
        c.add_argument("-b", "-l", "--max-line-length", "--line-bound", dest="line_bound", default=text.LINE_BOUND, type=int)
        c.add_argument("-t", "--text-freeform-threshold", "--freeform-threshold", dest="freeform_threshold", default=feeds.CheckParams.freeform_threshold, type=int)
        c.add_argument("--schema")
        c.add_argument("-r", "--reservoir-sampling", "--reservoir-size", dest="reservoir_size", type=int)
        c.add_argument("--max-pii", default=feeds.CheckParams.max_pii, type=int)
        c.add_argument("--no-pii", action="store_true")
        c.add_argument("-d", "--include-dot-files", action="store_true")
        c.add_argument("-f", "--force", action="store_true")
        c.add_argument("-x", "--exit-check-status", "--exit-status", dest="exit_status", action="store_true", help="exit with 1 if the check fails")
        c.add_argument("-e", "--exit-success", action="store_true", help="accepted, and the default")
        c.add_argument("-v", "--verbose", action="store_true")
        c.add_argument("--markers", default=".")
        return c

    for name in ("check", "check-file", "sanity"):
        checks(name)
    i = sub.add_parser("infer")
    i.add_argument("markers", nargs="+")
    i.add_argument("-m", "--schema-match-ratio", "--match-ratio", dest="match_ratio", default=sch.MATCH_RATIO, type=float)
    i.add_argument("-i", "--include-failed-checks", "--use-failed", dest="use_failed", action="store_true")
    i.add_argument("-o", "--output-schema", "--output", dest="output", default="schema.json")
    i.add_argument("-v", "--verbose", action="store_true", help="print the fields' histograms of types")
    m = sub.add_parser("marker").add_subparsers(dest="action", required=True)
    m.add_parser("failed").add_argument("markers", nargs="+")
    s = sub.add_parser("schema").add_subparsers(dest="action", required=True)
    s.add_parser("validate").add_argument("file")
    a = sub.add_parser("sample").add_subparsers(dest="action", required=True)
    e = a.add_parser("extract")
    e.add_argument("markers", nargs="*")
    e.add_argument("-o", "--output", required=True)
    r = a.add_parser("summarise")
    r.add_argument("markers", nargs="*")
    r.add_argument("-o", "--output", default=".")
    g = sub.add_parser("generate")
    g.add_argument("root")
    g.add_argument("-n", "--count", default=1_000_000, type=int)
    g.add_argument("--size", default=4, type=int)
    g.add_argument("--long-lines", action="store_true")
    g.add_argument("--seed", default=0, type=int)
    return p


def _params(a: argparse.Namespace) -> feeds.CheckParams:
    return feeds.CheckParams(a.separator, a.file_format, a.line_bound, a.freeform_threshold, a.schema, a.reservoir_size, None if a.no_pii else a.max_pii, a.include_dot_files, a.force, a.exit_status, a.verbose)


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    """Exit code: 0, or 1 for an error, or for a failed check if the status was asked for."""
    a = parser().parse_args(argv)
    say = lambda *x: print(*x, file=out)
    if a.dry_run:
        say(" ".join(f"{k}={v!r}" for k, v in sorted(vars(a).items()) if k != "dry_run"))
        return 0
    try:
        if a.command in ("check", "check-file", "sanity"):
            params = _params(a)
            if a.command == "sanity":
                result = feeds.Outcome(feeds.sanity(spark, views.traverse(spark, a.path, params.include_dot_files), params))
            else:
                result = (feeds.check if a.command == "check" else feeds.check_file)(spark, a.path, params, a.markers)
            for line in result.lines():
                say(line)
            return int(params.exit_on_failure and not result.passed)
        if a.command == "infer":
            markers.write_text(spark, a.output, sch.render_schema(feeds.infer(spark, a.markers, a.match_ratio, a.use_failed, say if a.verbose else None)))
        elif a.command == "marker":
            for r in markers.failed(markers.checked(markers.read_markers(spark, a.markers))).select("path").orderBy("path").collect():
                say(r["path"])
        elif a.command == "schema":
            sch.parse_schema(markers.read_text(spark, a.file))
        elif a.command == "sample":
            (feeds.extract_samples if a.action == "extract" else feeds.summarise)(spark, a.markers, a.output)
        else:
            generate.generate_view(spark, a.root, a.count, files=a.size, long_lines=a.long_lines, seed=a.seed)
    except (ValueError, OSError) as e:
        say(f"error: {e}")
        return 1
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("gaugeline").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
