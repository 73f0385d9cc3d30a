"""Command line over the engine: land, score, merge, export, verify. Exit codes: 0 fine, 1 partial, 2 failed."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rolescape import config, sinks
from rolescape.operators import dedup, integrity, ledger, reports, scoring
from rolescape.shared import written
from rolescape.sources import payloads, registry
from rolescape.store import Store


def collect(spark: SparkSession, args: argparse.Namespace) -> int:
    """Score landed payloads (source_name, company, payload) and merge them into the ledger."""
    as_of = F.lit(args.as_of).cast("timestamp") if args.as_of else F.current_timestamp()
    taxonomy = config.taxonomy(args.config) if args.config else config.Taxonomy()
    rows = payloads.read(args.kind, spark.read.parquet(args.landed))
    scored = scoring.score(rows, config.profile(args.config), as_of, taxonomy)
    kept = scoring.profile_filter(scored) if args.filter else scored
    # arrival follows the order of what makes a posting, so that one landing always merges alike
    numbered = written(kept.orderBy("source_name", "found_at", "apply_url", "title", "company", "description"), "landing").withColumn("seq", F.monotonically_increasing_id())
    totals = ledger.counts(Store(spark, args.root).upsert(numbered)).first()
    print(f"new {totals['new']}, updated {totals['updated']}")
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    """Write the views of the ledger as CSV folders."""
    jobs = Store(spark, args.root).read("jobs")
    live = reports.active(jobs)
    sinks.write_views({"representatives": dedup.representatives_sorted(live), "variants": dedup.variants(live), "by_country": dedup.summary_by(live, "country"), "by_company": dedup.summary_by(live, "company"), "high_priority": reports.high_priority(live), "top_100": reports.top_jobs(live)}, args.out)
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Print every check with its violations; 2 if there are any."""
    store = Store(spark, args.root)
    tables = [store.read(t) for t in ("jobs", "job_identity_aliases", "private_imports", "gmail_alert_jobs", "gmail_alert_messages")]
    found = integrity.verify(*tables).orderBy("check").collect()
    for r in found:
        print(f"{r['check']}: {r['violations']}")
    return 2 if any(r["violations"] for r in found) else 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Check a registry folder; 2 with the reason if it is invalid."""
    try:
        print(f"{registry.registry(spark, Path(args.config), args.file).count()} companies")
    except ValueError as e:
        print(e)
        return 2
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rolescape", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("collect", help=collect.__doc__)
    c.add_argument("kind", choices=sorted(payloads.READERS))
    c.add_argument("landed")
    c.add_argument("root")
    c.add_argument("--config")
    c.add_argument("--as-of")
    c.add_argument("--filter", action="store_true")
    e = commands.add_parser("export", help=export.__doc__)
    e.add_argument("root")
    e.add_argument("out")
    v = commands.add_parser("verify", help=verify.__doc__)
    v.add_argument("root")
    r = commands.add_parser("validate", help=validate.__doc__)
    r.add_argument("config")
    r.add_argument("--file", default="companies.yaml")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rolescape").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"collect": collect, "export": export, "verify": verify, "validate": validate}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
