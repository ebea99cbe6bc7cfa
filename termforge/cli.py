"""Command line: python -m termforge.cli extract|explain|config|version ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termforge.config import VERSION, Config
from termforge.operators import analysis
from termforge.plans import extraction, render
from termforge.resources import Resources
from termforge.sources import parse


def options() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config-file", help="JSON with some of the settings")
    shared.add_argument("--wordlist-size", type=int)
    shared.add_argument("--threshold-identifier", type=float)
    shared.add_argument("--threshold-technical", type=float)
    shared.add_argument("--wordlist", help="word list that replaces the bundled one")
    shared.add_argument("--stopwords")
    shared.add_argument("--lemmas")
    top = argparse.ArgumentParser(prog="termforge")
    commands = top.add_subparsers(dest="command", required=True)
    x = commands.add_parser("extract", parents=[shared])
    x.add_argument("paths", nargs="+")
    x.add_argument("--format", choices=("table", "json", "jsonl", "csv"))
    x.add_argument("--kind", action="append", choices=[k.lower() for k in extraction.KINDS])
    x.add_argument("--top", type=int)
    x.add_argument("--features", action="store_true")
    x.add_argument("--strict", action="store_true")
    x.add_argument("--quiet", action="store_true")
    x.add_argument("--output", help="folder to write to in parallel (jsonl or csv), instead of standard output")
    e = commands.add_parser("explain", parents=[shared])
    e.add_argument("path")
    e.add_argument("--near-misses", action="store_true")
    e.add_argument("--near-miss-limit", type=int, default=15)
    commands.add_parser("config", parents=[shared])
    commands.add_parser("version", parents=[shared])
    return top


def settings(args: argparse.Namespace) -> tuple[Config, str]:
    """The settings, and where they come from."""
    config, source = Config(), "defaults"
    if args.config_file:
        with open(args.config_file, encoding="utf-8") as f:
            config, source = Config.from_json(f.read()), args.config_file
    changed = []
    if args.wordlist_size is not None:
        config, changed = config.replace(wordlist_size=args.wordlist_size), [*changed, "--wordlist-size"]
    for name in ("identifier", "technical"):
        if (value := getattr(args, f"threshold_{name}")) is not None:
            import dataclasses

            config, changed = config.replace(thresholds=dataclasses.replace(config.thresholds, **{name: value})), [*changed, f"--threshold-{name}"]
    return config, " + ".join([source, *changed])


def _resources(spark: SparkSession, args: argparse.Namespace, config: Config) -> Resources:
    return Resources.from_files(spark, config, **{k: v for k in ("wordlist", "stopwords", "lemmas") if (v := getattr(args, k))})


def extract(spark: SparkSession, args: argparse.Namespace, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    config, source = settings(args)
    config = config.replace(retain_features=args.features)
    resources = _resources(spark, args, config)
    form = args.format or ("table" if out.isatty() else "jsonl")
    try:
        found = parse.files(spark, args.paths)
        docs = parse.documents(found, config.no_text_layer_threshold).persist()
        total = found.select("path").count()
    except AnalysisException as e:
        print(f"cannot read: {str(e).splitlines()[0]}", file=err)
        return 1
    x = extraction.extract(docs, config, resources)
    if not args.quiet:
        print(f"termforge {VERSION}  settings: {source}  words: {resources.extent[0]} of {resources.extent[1]}  stamp: {config.stamp(resources.digests)[:12]}", file=err)
    kinds = [k for k in extraction.KINDS if not args.kind or k.lower() in args.kind]
    rows = render.records(x, kinds, args.top, args.features)
    try:
        if args.output:
            {"jsonl": render.write_json_lines, "csv": render.write_csv}[form](rows, args.output)
        elif form == "json":
            print(render.json_text(rows), file=out)
        else:
            lines = {"jsonl": lambda: (r["value"] + "\n" for r in render.json_lines(rows.orderBy("path")).toLocalIterator()), "csv": lambda: render.csv_text(rows), "table": lambda: (t + "\n" for t in render.table_text(rows, config))}[form]()
            for line in lines:
                out.write(line)
    except BrokenPipeError:
        return 0
    counts = {r["status"]: r["documents"] for r in analysis.tally(x.documents).orderBy("status").collect()}
    unreadable = total - sum(counts.values())
    print(render.tally_line(counts, unreadable), file=err)
    return render.exit_code(counts, unreadable, args.strict)


def explain(spark: SparkSession, args: argparse.Namespace, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    config, source = settings(args)
    try:
        docs = parse.documents(parse.files(spark, args.path), config.no_text_layer_threshold)
    except AnalysisException as e:
        print(f"cannot read: {str(e).splitlines()[0]}", file=err)
        return 1
    x = extraction.extract(docs, config, _resources(spark, args, config))
    w, t = config.shape_weights, config.thresholds
    print(f"settings: {source}\nthresholds: identifier {t.identifier:g}, technical {t.technical:g}, topical {t.topical:g}", file=out)
    print("weights: " + ", ".join(f"{k} {v:g}" for k, v in vars(w).items()), file=out)
    parts: dict[str, list[str]] = {}
    for r in analysis.components(x.candidates, config).orderBy("normalised", F.desc("contribution")).toLocalIterator():
        parts.setdefault(r["normalised"], []).append(f"{r['name']} {r['value']:g} x {r['weight']:g} = {r['contribution']:.3f}")
    for r in x.keywords.orderBy("kind", "rank").toLocalIterator():
        print(f"{r['kind']} {r['rank']}  {r['score']:.3f}  {render.short(r['original_keyword'])}  {render.origin_label(r['origin'], r['expansion'])}", file=out)
        if r["origin"] == "Shape":
            out.writelines(f"      {p}\n" for p in parts.get(r["normalised"], []))
    if args.near_misses:
        print("below the thresholds:", file=out)
        for r in analysis.near_misses(x.candidates, config, args.near_miss_limit).orderBy("doc_id", "place").toLocalIterator():
            print(f"  {r['score']:.3f}  {render.short(r['surface'])}  {r['kind']}", file=out)
            out.writelines(f"      {p}\n" for p in parts.get(r["normalised"], []))
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    args = options().parse_args(argv)
    out, err = out or sys.stdout, err or sys.stderr
    spark = spark or SparkSession.builder.appName("termforge").getOrCreate()
    if args.command in ("config", "version"):
        config, _ = settings(args)
        resources = _resources(spark, args, config)
        stamp = config.stamp(resources.digests)
        if args.command == "config":
            print(config.to_json(), file=out)
            print(stamp, file=err)
        else:
            print(f"termforge {VERSION}\nwords {resources.extent[0]} of {resources.extent[1]}\nstamp {stamp}", file=out)
        return 0
    return {"extract": extract, "explain": explain}[args.command](spark, args, out, err)


if __name__ == "__main__":
    sys.exit(main())
