"""Command line: run a job from its JSON description and inspect run history.

    python -m tidewater run SPEC.json [--store DIR] [--run-type TEST] [--test-limit 100]
    python -m tidewater stream SPEC.json --path DIR --schema DDL [--trigger "30 seconds"]
    python -m tidewater preview SPEC.json [--rows 20]
    python -m tidewater describe SPEC.json
    python -m tidewater runs --store DIR [--limit 10] [--status SUCCESS]
    python -m tidewater logs --store DIR --run RUN_ID
    python -m tidewater rejected --store DIR --run RUN_ID [--limit 100]

Results are printed as JSON lines.  On a cluster:

    spark-submit --py-files tidewater.zip --conf spark.checkpoint.dir=hdfs:///shared/ckpt \
        tidewater/__main__.py run pipeline.json --store hdfs:///shared/tidewater-store

(master and sizing come from spark-submit; ``--master`` is for local use).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from tidewater.errors import JobError


def _session(args):
    from tidewater.session import build_session
    return build_session(args.master, app="tidewater-cli", shuffle_partitions=args.shuffle_partitions)


def _spec(path: str):
    from tidewater.spec import job_from_dict
    with open(path, encoding="utf-8") as f:
        return job_from_dict(json.load(f))


def _store(spark, base):
    from tidewater.plans.store import RunStore
    return RunStore(spark, base) if base else RunStore.default(spark)


def _print_rows(df, limit: int | None = None) -> None:
    for r in df.limit(limit).collect() if limit else df.toLocalIterator():  # all rows: a partition at a time
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv=None, spark=None) -> int:
    """Run one command; ``spark`` reuses a session (and leaves it running)."""
    p = argparse.ArgumentParser(prog="tidewater")
    # unset: spark-submit / the cluster configuration decides
    p.add_argument("--master", default=None)
    p.add_argument("--shuffle-partitions", type=int, default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("spec")
    r.add_argument("--store")
    r.add_argument("--run-type", default="MANUAL")
    r.add_argument("--test-limit", type=int)
    s = sub.add_parser("stream")
    s.add_argument("spec")
    s.add_argument("--path", required=True)
    s.add_argument("--schema", required=True)
    s.add_argument("--format", default="parquet")
    s.add_argument("--store")
    s.add_argument("--trigger", default="availableNow")
    s.add_argument("--checkpoint", help="stream checkpoint folder (default: in the store, by job)")
    for name in ("preview", "describe"):
        q = sub.add_parser(name)
        q.add_argument("spec")
        q.add_argument("--rows", type=int, default=20)
    for name in ("runs", "logs", "rejected"):
        q = sub.add_parser(name)
        q.add_argument("--store")
        q.add_argument("--run")
        q.add_argument("--status")
        q.add_argument("--limit", type=int, default=100 if name == "rejected" else 10)
    args = p.parse_args(argv)

    own = spark is None
    spark = _session(args) if own else spark
    try:
        if args.cmd == "run":
            from tidewater.plans.runner import run_job
            res = run_job(spark, _spec(args.spec), _store(spark, args.store), run_type=args.run_type,
                          test_limit=args.test_limit, raise_on_error=False)
            print(json.dumps(dataclasses.asdict(res), default=str, ensure_ascii=False))
            return 0 if res.status == "SUCCESS" else 1
        if args.cmd == "stream":
            from tidewater.streaming.scheduled import start_stream
            q = start_stream(spark, _spec(args.spec), args.path, args.schema, fmt=args.format,
                             store=_store(spark, args.store), trigger=args.trigger, checkpoint_location=args.checkpoint)
            q.awaitTermination()
            return 0
        if args.cmd in ("preview", "describe"):
            from tidewater.sources.readers import describe, preview, read_source
            df = read_source(spark, _spec(args.spec).source)
            _print_rows(preview(df, args.rows) if args.cmd == "preview" else describe(spark, df))
            return 0
        from tidewater.operators import history
        store = _store(spark, args.store)
        if args.cmd == "runs":
            _print_rows(history.list_runs(store.runs(), status=args.status, limit=args.limit))
        elif args.cmd == "logs":
            logs = history.run_log(store.logs(), args.run, order_cols=("seq",))
            _print_rows(logs if args.run else logs.limit(args.limit))
        else:
            v = store.violations_of(args.run) if args.run else store.violations()
            if v is not None:
                from tidewater.plans.store import violations_as_json
                _print_rows(history.rejected_of_run(violations_as_json(v), args.run, limit=args.limit,
                                                    order_cols=("rule_index",)))
        return 0
    except JobError as e:
        print(json.dumps({"error": e.code, "message": e.message, "detail": e.detail}, ensure_ascii=False))
        return 2
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
