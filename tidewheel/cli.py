"""python -m tidewheel.cli validate JOB | package FOLDER | run JOB; exit codes: 0 ok, 1 failed, 3 bad job, 4 bad input.

JOB is a document or a bundle.  run reads the sources by the job's config, or from --input tables; with --stream it keeps
running until it is interrupted, which cancels the job.
"""

from __future__ import annotations

import argparse
import sys
import zipfile
from pathlib import Path

from . import observability
from .plans import bundle, planner, spec


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidewheel")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate").add_argument("job", type=Path)
    pack = commands.add_parser("package")
    pack.add_argument("folder", type=Path)
    pack.add_argument("--output-dir", type=Path, default=Path("bundles"))
    run = commands.add_parser("run")
    run.add_argument("job", type=Path)
    run.add_argument("--input", action="append", default=[], help="SOURCE=PATH of a Parquet table of envelopes")
    run.add_argument("--stream", metavar="CHECKPOINT", help="run as streams with this checkpoint folder")
    return parser


def _run(job: spec.Job, args) -> None:
    from pyspark.sql import SparkSession

    from .sources.records import COLUMNS

    log = observability.logger(job_id=job.name)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if zipfile.is_zipfile(args.job):
        bundle.ship(spark, args.job)
    tables = {k: spark.read.parquet(p) for k, p in (x.split("=", 1) for x in args.input)}
    sources = {k: t.select(*[c for c in COLUMNS if c in t.columns]) for k, t in tables.items()} or None
    if not args.stream:
        for path in planner.run(spark, job, sources):
            log.info("sink written", extra={"path": path})
            print(path)
        return
    queries = planner.start(spark, job, args.stream, sources)
    try:
        for _, path in queries.values():
            print(path)
        spark.streams.awaitAnyTermination()
    except KeyboardInterrupt:
        log.info("cancelled")
    finally:
        for query, _ in queries.values():
            query.stop()


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    observability.configure()
    try:
        if args.command == "package":
            print(bundle.build(args.folder, args.output_dir))
            return 0
        job = bundle.read(args.job) if zipfile.is_zipfile(args.job) else spec.load(args.job.read_text(encoding="utf-8"))
    except spec.SpecError as e:
        for path, message in e.findings:
            print(f"{path or '(document)'}: {message}", file=sys.stderr)
        return 3
    except (bundle.BundleError, UnicodeDecodeError) as e:
        print(e, file=sys.stderr)
        return 3
    except OSError as e:
        print(e, file=sys.stderr)
        return 4
    if args.command == "validate":
        print(f"{job.name}: {len(job.operators)} operators, order {' '.join(job.order)}")
        return 0
    try:
        _run(job, args)
    except Exception as e:  # noqa: BLE001
        observability.logger(job_id=job.name).error("job failed", exc_info=True)
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
