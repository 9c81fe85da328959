"""Command line: convert, inspect, materialize, draft-schema, canonicalize, corpus-validate, corpus-compose, corpus-gc."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from matrixlake.plans import canonical, corpus, drafting, inspection, manage
from matrixlake.session import session
from matrixlake.sources import tables


def _tables(spark, source: str):
    """A source folder holds matrix.parquet (row, gene, value), obs.parquet and var.parquet."""
    return tables.read_coo(spark, f"{source}/matrix.parquet"), spark.read.parquet(f"{source}/obs.parquet"), spark.read.parquet(f"{source}/var.parquet")


def convert(a) -> int:
    coo, obs, var = _tables(session(), a.source)
    corpus.convert(coo, obs, var, a.output, a.layers, a.attempt_conversion, a.no_count, a.round_counts, tuple(a.features.split("=", 1)) if a.features else None)
    return 0


def _items(a) -> list[dict]:
    given = [x for x in (a.source, a.input_list, a.input_dir) if x]
    if len(given) != 1:
        raise SystemExit("choose one of --source, --input-list and --input-dir")
    if a.source:
        if not (a.dataset_id and a.inspection_summary):
            raise SystemExit("--source needs --dataset-id and --inspection-summary")
        return [{"source": a.source, "dataset_id": a.dataset_id, "inspection_summary": a.inspection_summary}]
    return tables.read_input_list(a.input_list) if a.input_list else tables.scan_inputs(a.input_dir, "", a.inspection_dir)


def inspect(a) -> int:
    spark = session()
    items = tables.read_yaml(a.config, ("datasets",))["datasets"] if a.config else [{"source": a.source, "dataset_id": a.dataset_id}]
    done = []
    for item in sorted(items, key=lambda i: i["dataset_id"]):
        coo, obs, var = _tables(spark, item["source"])
        out = inspection.inspect(obs, {item.get("matrix", ".X"): (coo, obs.count(), var.count())}, item["dataset_id"], a.output)
        done.append({"dataset_id": item["dataset_id"], "readiness": out["readiness"]})
    tables.write_yaml({"kind": "inspection-batch", "datasets": done}, Path(a.output, "inspection-batch.yaml"))
    return 0


def materialize(a) -> int:
    spark = session()

    def one(item: dict) -> None:
        coo, obs, var = _tables(spark, item["source"])
        manage.materialize_dataset(a.corpus, item["dataset_id"], coo, obs, var, tables.read_yaml(item["inspection_summary"], kind="dataset-summary"), a.topology)

    if a.mode == "create" and Path(a.corpus, manage.INDEX).exists():
        raise SystemExit(f"{a.corpus} is a corpus already; use --mode append")
    for d in manage.materialize_many(_items(a), one, a.dry_run):
        print(d)
    return 0


def draft_schema(a) -> int:
    spark = session()
    obs, var = spark.read.parquet(a.obs), spark.read.parquet(a.var)
    drafting.draft(a.dataset_id, obs.columns, var.columns, drafting.samples_of(obs), drafting.samples_of(var)).write(a.output)
    return 0


def canonicalize(a) -> int:
    spark, failed = session(), 0
    for item in [d["dataset_id"] for d in manage.read_index(a.corpus)["datasets"]] if a.all else [a.dataset_id]:
        paths = manage.dataset_paths(a.corpus, item, manage.read_index(a.corpus)["topology"])
        try:
            canonical.canonicalize(spark, f"{paths['meta']}/raw-obs.parquet", f"{paths['meta']}/raw-var.parquet", a.schema or f"{paths['meta']}/schema.yaml", paths["canonical"])
        except Exception as e:
            print(f"{item}: {e}", file=sys.stderr)
            failed += 1
    return int(failed > 0)


def corpus_validate(a) -> int:
    wrong = manage.validate(a.corpus, a.strict, a.backend)
    print("\n".join(wrong) or "valid")
    return int(bool(wrong))


def corpus_compose(a) -> int:
    manage.compose(a.output, [tuple(p.rsplit(":", 1)) for p in a.pick], not a.copy)
    return 0


def corpus_gc(a) -> int:
    print("\n".join(manage.collect_garbage(a.corpus, a.dry_run)))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matrixlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        s = sub.add_parser(name)
        for flag, kw in options:
            s.add_argument(flag, **kw)
        s.set_defaults(run=run)

    need, text, flag = {"required": True}, {}, {"action": "store_true"}
    command("convert", convert, ("--source", need), ("--output", need), ("--layers", text), ("--attempt-conversion", flag), ("--no-count", flag), ("--round-counts", flag), ("--features", text))
    command("inspect", inspect, ("--config", text), ("--source", text), ("--dataset-id", text), ("--output", need))
    command("materialize", materialize, ("--corpus", need), ("--mode", {"choices": ("create", "append"), "default": "append"}), ("--source", text), ("--dataset-id", text), ("--inspection-summary", text), ("--input-list", text), ("--input-dir", text), ("--inspection-dir", text), ("--topology", {"choices": ("federated", "aggregate"), "default": "federated"}), ("--dry-run", flag))
    command("draft-schema", draft_schema, ("--dataset-id", need), ("--obs", need), ("--var", need), ("--output", need))
    command("canonicalize", canonicalize, ("--corpus", need), ("--dataset-id", text), ("--schema", text), ("--all", flag))
    command("corpus-validate", corpus_validate, ("--corpus", need), ("--backend", text), ("--strict", flag))
    command("corpus-compose", corpus_compose, ("--output", need), ("--pick", {"action": "append", "required": True, "help": "corpus:dataset"}), ("--copy", flag))
    command("corpus-gc", corpus_gc, ("--corpus", need), ("--dry-run", flag))
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "inspect" and bool(a.config) == bool(a.source):
        raise SystemExit("choose one of --config and --source")
    return a.run(a)
