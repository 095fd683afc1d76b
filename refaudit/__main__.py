"""Command line: check reference lists, print a DOI's entry, evaluate labelled pairs and more."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refaudit import config
from refaudit.functions import text
from refaudit.operators import ranking, report, scoring
from refaudit.plans.engine import FIELDS, Engine
from refaudit.session import atomic_write, read
from refaudit.sources import adapters, bibtex

#: Names of the source tables in a folder; any other source is looked for under its own name.
TABLES = {"crossref": "search_crossref", "openalex": "search_openalex", "europe_pmc": "search_europepmc", "semantic_scholar": "match_s2"}


def tables_of(spark: SparkSession, folder: str | None, named: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of the sources: those of the settings, and those found in the folder."""
    out = {s: spark.read.parquet(p) for s, p in named.items()}
    for source in adapters.ACCESS:
        for name in (TABLES.get(source, source), source):
            if folder and source not in out and os.path.exists(os.path.join(folder, f"{name}.parquet")):
                out[source] = read(spark, folder, name)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("refaudit")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, settings: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        if settings:
            c.add_argument("--config", default="config.json")
        return c

    check = command("check", "verify the entries of a reference list")
    check.add_argument("file", nargs="?")
    check.add_argument("--tables")
    check.add_argument("--output-dir")
    check.add_argument("--encoding")
    check.add_argument("--language", type=str.upper, choices=config.LANGUAGES)
    check.add_argument("--format", choices=config.FORMS)
    check.add_argument("--json", action="store_true")
    check.add_argument("--quiet", action="store_true")
    check.add_argument("--workspace-root")
    once = check.add_mutually_exclusive_group()
    once.add_argument("--dry-run", action="store_true")
    once.add_argument("--apply", action="store_true")
    doi = command("doi", "the entry of a DOI")
    doi.add_argument("doi")
    doi.add_argument("--tables", required=True)
    doi.add_argument("--key")
    doi.add_argument("--json", action="store_true")
    bench = command("evaluate", "metrics over labelled pairs", settings=False)
    bench.add_argument("--tables")
    bench.add_argument("--dataset")
    init = command("init", "write a file of settings to start from", settings=False)
    init.add_argument("--output", default="config.json")
    init.add_argument("--force", action="store_true")
    sources = command("sources", "the sources in their order", settings=False)
    sources.add_argument("--json", action="store_true")
    command("clear-cache", "remove the stored responses")
    rank = command("rank", "the order in which the sources are asked for an entry, given as JSON")
    rank.add_argument("entry")
    diff = command("diff", "the fields in which two entries, given as JSON, differ", settings=False)
    diff.add_argument("original")
    diff.add_argument("updated")
    command("doctor", "whether the settings can be read and what is installed")
    return p


def verify_file(a: argparse.Namespace, settings: dict, spark: SparkSession) -> tuple[dict, int]:
    """Verify one list and write what the settings ask for; (summary, exit code)."""
    engine = Engine(spark, config.to_settings(settings))
    path, out = settings["bib_file"], settings["output_settings"]
    if a.workspace_root:
        for p in (path, settings["output_dir"]):
            config.within(a.workspace_root, p)
    body, encoding = bibtex.decode(Path(path).read_bytes(), bibtex.ENCODINGS if settings["encoding"] == "auto" else (settings["encoding"],))
    if body is None:
        raise ValueError(f"{path} is in none of the encodings asked for")
    entries = engine.entries(path, settings["encoding"]).drop("path").cache()  # one list of the driver's disk
    results = engine.verify(entries, tables_of(spark, a.tables, settings["tables"])).cache()
    total = report.summary(results).first().asDict(recursive=True)
    files: dict[str, str | None] = dict.fromkeys(("report", "backup", "updated", "review", "applied"))
    if not a.dry_run:
        stamp = datetime.now().strftime(out["timestamp_format"])
        prefix = spark.range(1).select(text.file_prefix(F.lit(Path(path).stem))).first()[0]
        os.makedirs(settings["output_dir"], exist_ok=True)
        name = lambda kind, end: os.path.join(settings["output_dir"], f"{prefix}_{kind}_{stamp}.{end}")
        if out["generate_report"]:
            files["report"] = name("report", out["report_format"])
            about = {"input": path, "generated_at": datetime.now().astimezone().isoformat(timespec="seconds")}
            lines = report.lines(results, out["report_format"], settings["language"], about).orderBy("part", "at").toLocalIterator()
            atomic_write(files["report"], "\n".join(r["value"] for r in lines) + "\n")
        if out["generate_backup"] or a.apply:
            files["backup"] = name("backup", "bib")
            shutil.copyfile(path, files["backup"])
        applies = results.where(F.coalesce("n_applied", F.lit(0)) > 0).limit(1).count() > 0
        if applies and out["generate_updated_bib"]:
            files["updated"] = name("updated", "bib")
            engine.write_file(files["updated"], engine.updated(entries, results), ["pos"], like=body)
        if out["generate_review_bib"] and results.where(F.col("bucket").isin(*report.REVIEW)).limit(1).count():
            files["review"] = name("review", "bib")
            engine.write_file(files["review"], engine.review(entries, results), ["bucket_ord", "pos"], like=body)
        if a.apply and engine.apply(path, entries, results, backup=None, encoding=settings["encoding"]):
            files["applied"] = path
    counts = total["counts"]
    code = spark.range(1).select(ranking.exit_code({b: F.lit(counts[b]) for b in report.BUCKETS}, F.lit(total["complete"]))).first()[0]
    shown = {**total, "bib_file": path, "output_dir": settings["output_dir"], "encoding": encoding, "dry_run": a.dry_run, "applied": files["applied"] is not None, "files": files}
    return shown, code


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    say = lambda x: print(json.dumps(x, ensure_ascii=False))
    if a.command == "sources":
        rows = [{"source": n, "priority": p, "enabled": on, "adapter": n in adapters.ACCESS} for n, p, on in ranking.SOURCES]
        if a.json:
            say(rows)
        for r in [] if a.json else rows:
            print(f"{r['priority']:3d} {r['source']}{'' if r['enabled'] else ' (off)'}{'' if r['adapter'] else ' (no adapter)'}")
        return 0
    if a.command == "init":
        try:
            config.write_starter(a.output, a.force)
        except FileExistsError:
            print(f"{a.output} exists", file=sys.stderr)
            return 2
        return 0
    settings: dict = {}
    if "config" in a:
        over: dict = {}
        for name, value in (("bib_file", getattr(a, "file", None)), ("output_dir", getattr(a, "output_dir", None))):
            if value:
                over[name] = str(Path(value).absolute())
        for name in ("encoding", "language"):
            if getattr(a, name, None):
                over[name] = getattr(a, name)
        if getattr(a, "format", None):
            over["output_settings"] = {"report_format": a.format}
        try:
            settings = config.load(a.config, over)
        except (OSError, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 5
    if a.command == "doctor":
        say({"python": sys.version.split()[0], "config": a.config, "config_found": os.path.exists(a.config), "bib_file": os.path.exists(settings["bib_file"]), "sources": sorted(adapters.ACCESS)})
        return 0
    if a.command == "clear-cache":
        path = settings["query_settings"]["cache_path"]
        print("removed" if os.path.exists(path) else "nothing to remove")
        shutil.rmtree(path, ignore_errors=True)
        return 0
    spark = SparkSession.builder.appName("refaudit").getOrCreate()
    engine = Engine(spark, config.to_settings(settings) if settings else None)
    if a.command == "rank":
        given = {k: str(v) for k, v in json.loads(a.entry).items()}
        row = spark.createDataFrame([(1, *[given.get(f, "") for f in FIELDS])], ", ".join(["pos bigint", *[f"{f} string" for f in FIELDS]]))
        say({"sources": [r["source"] for r in engine.rank(row).orderBy("rank").collect()]})
        return 0
    if a.command == "diff":
        sides = [{k: str(v) for k, v in json.loads(x).items()} for x in (a.original, a.updated)]
        frames = [spark.createDataFrame([(1, *s.values())], ", ".join(["pos bigint", *[f"`{k}` string" for k in s]])) for s in sides]
        say({"differences": {r["field"]: {"original": r["original"], "updated": r["updated"]} for r in engine.explain(*frames, ["pos"]).collect()}})
        return 0
    if a.command == "doi":
        rows = engine.doi_to_bibtex(a.doi, tables_of(spark, a.tables, settings["tables"])["crossref"], a.key).take(1)
        if not rows:
            print("not found", end="")
            return 1
        if a.json:
            say({"doi": a.doi, "bibtex": rows[0][0].strip()})
        else:
            print(rows[0][0], end="")
        return 0
    if a.command == "evaluate":
        pairs = engine.labelled_pairs(a.dataset) if a.dataset else read(spark, a.tables, "cases").where("original is not null and candidate is not null")
        m = report.metrics(scoring.assess(pairs).select("expected", F.col("status").alias("predicted"))).first().asDict()
        say(m)
        return int(m["wrong_auto_match_rate"] > 0)
    try:
        shown, code = verify_file(a, settings, spark)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 5
    if a.json or not a.quiet:
        say(shown)
    return code


if __name__ == "__main__":
    sys.exit(main())
