"""Runs from the command line: ``python -m manloom compare --docs manuals --recordings logs --out run``."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators.crawl import Limits
from .plans import runs
from .sources import report, sinks

#: What a run ends with.
DONE, USAGE, FAILED = 0, 2, 4
SETTINGS = {"limits": dict, "config_commands": list, "version_commands": list, "preferred_language": str}


def parser() -> argparse.ArgumentParser:
    told = argparse.ArgumentParser(prog="manloom", description="Commands of a device, from its recorded sessions and its manuals.")
    told.add_argument("mode", choices=("compare", "audit", "docs"), help="compare: recordings against manuals; audit: recordings alone; docs: manuals alone")
    told.add_argument("--docs", help="folder of manuals")
    told.add_argument("--recordings", help="folder of raw session recordings")
    told.add_argument("--profiles", help="folder of profiles of manuals (default: the built-in ones)")
    told.add_argument("--config", type=Path, help="settings as JSON: " + ", ".join(SETTINGS))
    told.add_argument("--out", help="folder that the results are written to")
    told.add_argument("--skim", action="store_true", help="look at the first two levels only")
    told.add_argument("--check-config", action="store_true", help="check the settings and stop")
    told.add_argument("--quiet", action="store_true", help="print nothing if all went well")
    return told


def settings(path: Path | None) -> dict:
    """The settings file with checked limits.  Unknown names and wrong types are refused."""
    given = json.loads(path.read_text(encoding="utf-8")) if path is not None else {}
    if not isinstance(given, dict):
        raise ValueError("settings must be an object")
    if unknown := sorted(set(given) - set(SETTINGS)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    for name, value in given.items():
        if not isinstance(value, SETTINGS[name]) or (isinstance(value, list) and not all(isinstance(v, str) and v.strip() for v in value)):
            raise ValueError(f"{name} must be a {SETTINGS[name].__name__}" + (" of commands" if SETTINGS[name] is list else ""))
    return given | {"limits": Limits.checked(given.get("limits", {}))}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Writes ``catalog``, ``commands``, ``tree`` and ``summary`` below ``--out``, of a recorded device also
    ``report``, ``contexts`` and ``gaps``, of manuals ``cards`` and ``skipped``.  0: done, also if the
    walk was incomplete, which the summary says; 2: wrong use or settings; 4: the run failed."""
    try:
        given = parser().parse_args(argv)
        told = settings(given.config)
        needs = [n for n, modes in (("docs", ("compare", "docs")), ("recordings", ("compare", "audit")), ("out", ("compare", "audit", "docs"))) if given.mode in modes and getattr(given, n) is None]
        if needs and not given.check_config:
            raise ValueError(f"mode {given.mode} needs " + ", ".join(f"--{n}" for n in needs))
    except SystemExit as stop:  # the parser has said what is wrong
        return USAGE if stop.code else DONE
    except (ValueError, TypeError, OSError) as error:
        print(f"manloom: {error}", file=sys.stderr)
        return USAGE
    if given.check_config:
        if not given.quiet:
            print("settings are right")
        return DONE
    try:
        summary = _run(spark or SparkSession.builder.appName("manloom").getOrCreate(), given, told)
    except Exception as error:  # noqa: BLE001 - the exit code tells
        print(f"manloom: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", file=sys.stderr)
        return FAILED
    if not given.quiet:
        print(json.dumps(summary, ensure_ascii=False))
    return DONE


def _run(spark: SparkSession, given: argparse.Namespace, told: dict) -> dict:
    put = lambda df, name: df.write.mode("overwrite").json(f"{given.out}/{name}")
    manuals = device = None
    if given.mode != "audit":
        manuals = runs.read_manuals(spark, given.docs, preferred=told.get("preferred_language"), **({"profiles": given.profiles} if given.profiles else {}))
        put(manuals.skipped, "skipped")
        put(manuals.records, "cards")
    if given.mode == "docs":
        run, catalog = manuals, manuals.catalog.withColumn("status", F.lit("parsed"))
    else:
        named = {k: told[k] for k in ("config_commands", "version_commands") if k in told}
        run = device = runs.read_recorded(spark, given.recordings, told["limits"], manuals=manuals.catalog if manuals else None, skim=given.skim, **named)
        catalog = run.catalog
    sinks.write_catalog(catalog, f"{given.out}/catalog")
    catalog = spark.read.schema(catalog.schema).json(f"{given.out}/catalog")
    listed = sinks.human_list(catalog, given.mode).select(F.concat_ws("  ", "command", F.nullif("description", F.lit(""))).alias("line"), "command")
    sinks.write_lines(listed, ["command"], f"{given.out}/commands")
    sinks.write_lines(sinks.tree_lines(catalog, given.mode), ["path"], f"{given.out}/tree")
    statuses = {"compare": C.STATUSES, "audit": ("present",), "docs": ("parsed",)}[given.mode]
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    sums = catalog.agg(F.count_if(C.on_device(F.col("sources"))).alias("device"), F.count_if(C.documented(F.col("sources"))).alias("manuals")).first()
    counts = {r["status"]: r["n"] for r in C.status_counts(catalog, statuses).collect()}  # a row a status
    totals = {k: v for k, v in run.totals.items() if isinstance(v, (bool, int))}
    held = {"compare": ("device", "manuals"), "audit": ("device",), "docs": ("manuals",)}[given.mode]
    summary = {"schema_version": 3, "mode": given.mode, "generated_at": now, "scan": totals, "summary": {n: sums[n] for n in held} | {s: counts[s] for s in statuses}}
    if device is not None:
        put(run.contexts, "contexts")
        put(run.gaps, "gaps")
        page = report.report_lines(catalog, given.mode, complete=totals["complete"], queries=totals["queries"], generated_at=now, firmware=run.firmware, coverage=run.coverage, gaps=run.gaps, contexts=run.contexts, executed=run.executed)
        report.write_report(page, f"{given.out}/report")
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{given.out}/summary")
    return summary


if __name__ == "__main__":
    sys.exit(main())
