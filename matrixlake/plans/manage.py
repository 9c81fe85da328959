"""Management of stored datasets: materialisation, index with row ranges, composition, checks, clean-up."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from pathlib import Path

from matrixlake.schema import CONTRACT_VERSION
from matrixlake.sources.tables import provenance, read_yaml, sidecar, write_once, write_yaml

INDEX = "corpus-index.yaml"


class ManageError(ValueError):
    """The corpus does not allow this."""


def dataset_paths(root: str, dataset_id: str, topology: str = "federated") -> dict[str, str]:
    if topology == "federated":
        base = f"{root}/{dataset_id}"
        return {"meta": f"{base}/meta", "matrix": f"{base}/matrix/{dataset_id}.parquet", "canonical": f"{base}/meta/canonical_meta"}
    if topology == "aggregate":
        return {"meta": f"{root}/meta/{dataset_id}", "matrix": f"{root}/matrix/aggregated-cells.parquet", "canonical": f"{root}/meta/{dataset_id}/canonical_meta"}
    raise ManageError(f"unknown topology {topology!r}")


def read_index(root: str) -> dict:
    path = Path(root, INDEX)
    return read_yaml(path, ("datasets", "topology")) if path.exists() else {"kind": "corpus-index", "contract_version": CONTRACT_VERSION, "topology": None, "backend": "parquet", "datasets": []}


def ranged(datasets: list[dict]) -> list[dict]:
    """Contiguous row ranges from 0, in order."""
    at, out = 0, []
    for i, d in enumerate(datasets):
        out.append({**d, "dataset_index": i, "global_start": at, "global_end": at + d["cell_count"]})
        at += d["cell_count"]
    return out


def register(root: str, dataset_id: str, cell_count: int, topology: str = "federated", backend: str = "parquet") -> dict:
    index = read_index(root)
    if any(d["dataset_id"] == dataset_id for d in index["datasets"]):
        raise ManageError(f"dataset {dataset_id} is registered already")
    if index["topology"] not in (None, topology) or index["backend"] != backend:
        raise ManageError(f"the corpus is {index['topology']} on {index['backend']}")
    index["topology"] = topology
    index["datasets"] = ranged([*index["datasets"], {"dataset_id": dataset_id, "cell_count": cell_count}])
    index["total_cells"] = sum(d["cell_count"] for d in index["datasets"])
    write_yaml(index, Path(root, INDEX))
    return index["datasets"][-1]


def materialize_dataset(root: str, dataset_id: str, coo, obs, var, summary: dict, topology: str = "federated", obs_filter=None, files: int = 1) -> dict:
    """Rows, sidecars, provenance and the index entry of an inspected dataset; only a readiness of ``pass`` is let in."""
    from pyspark.sql import functions as F

    from matrixlake.operators import counts as C

    if obs_filter is not None:
        raise ManageError("rows are filtered before, not here")
    if summary.get("readiness") != "pass":
        raise ManageError(f"{dataset_id}: readiness is {summary.get('readiness')}")
    index = read_index(root)
    if any(d["dataset_id"] == dataset_id for d in index["datasets"]):
        raise ManageError(f"dataset {dataset_id} is registered already")
    paths = dataset_paths(root, dataset_id, topology)
    start = index["datasets"][-1]["global_end"] if index["datasets"] and topology == "aggregate" else 0
    values = C.sum_duplicates(coo)
    values = C.recover_counts(values) if summary.get("needs_recovery") else C.validate_counts(values)
    rows = obs.select(F.col("local_row_index").alias("row")).join(C.to_rows(values), "row", "left")
    empty = F.expr("cast(array() as array<int>)")
    table = rows.select((F.col("row") + start).cast("long").alias("global_row_index"), F.coalesce("genes", empty).alias("genes"), F.coalesce("counts", empty).alias("counts"))
    table.repartitionByRange(files, "global_row_index").sortWithinPartitions("global_row_index").write.mode("append" if topology == "aggregate" else "errorifexists").parquet(paths["matrix"])
    n = obs.count()
    write_once(sidecar(obs.withColumn("dataset_id", F.lit(dataset_id)), ["cell_id", "dataset_id", "local_row_index"], "raw_fields"), f"{paths['meta']}/raw-obs.parquet")
    write_once(sidecar(var, ["origin_index", "feature_id"], "raw_var"), f"{paths['meta']}/raw-var.parquet")
    write_once(provenance(var, summary.get("count_source") or "", summary.get("source_path") or ""), f"{paths['meta']}/feature-provenance.parquet")
    manifest = {"kind": "materialization-manifest", "contract_version": CONTRACT_VERSION, "dataset_id": dataset_id, "topology": topology, "backend": "parquet", "cell_count": n, "count_source": summary.get("count_source"), "paths": paths}
    write_yaml(manifest, Path(paths["meta"], "materialization-manifest.yaml"))
    return register(root, dataset_id, n, topology)


def materialize_many(items: list[dict], one: Callable[[dict], object], dry_run: bool = False) -> list[str]:
    """Datasets in order; the first failure ends the run and leaves the earlier ones."""
    ids = [i["dataset_id"] for i in items]
    if twice := sorted({d for d in ids if ids.count(d) > 1}):
        raise ManageError(f"repeated datasets: {twice}")
    done = []
    for item in items:
        if not dry_run:
            one(item)
        done.append(item["dataset_id"])
    return done


def validate(root: str, strict: bool = False, backend: str | None = None) -> list[str]:
    """What is wrong with a corpus: missing or unreadable manifests, another backend; with ``strict`` also missing files."""
    wrong = []
    index = read_index(root)
    if not index["datasets"]:
        return [f"{root}: no datasets are registered"]
    if backend and index["backend"] != backend:
        wrong.append(f"backend is {index['backend']}, not {backend}")
    if ranged([{k: d[k] for k in ("dataset_id", "cell_count")} for d in index["datasets"]]) != index["datasets"]:
        wrong.append("row ranges are not contiguous")
    for d in index["datasets"]:
        paths = dataset_paths(root, d["dataset_id"], index["topology"])
        try:
            read_yaml(Path(paths["meta"], "materialization-manifest.yaml"), ("dataset_id", "cell_count"))
        except (OSError, ValueError) as e:
            wrong.append(f"{d['dataset_id']}: {e}")
        if strict:
            wrong += [f"{d['dataset_id']}: no {p}" for p in (paths["matrix"], f"{paths['canonical']}/canonical-obs.parquet") if not os.path.exists(p)]
    return wrong


def compose(output: str, picks: list[tuple[str, str]], link: bool = True) -> dict:
    """A corpus of chosen datasets (root, dataset_id) of federated corpora, linked or copied, with new row ranges."""
    if os.path.exists(output):
        raise FileExistsError(output)
    ids = [d for _, d in picks]
    if not picks or len(set(ids)) != len(ids):
        raise ManageError("choose datasets, each once")
    entries = []
    for root, d in picks:
        index = read_index(root)
        if index["topology"] != "federated":
            raise ManageError(f"{root}: only federated corpora can be composed")
        entry = next((e for e in index["datasets"] if e["dataset_id"] == d), None)
        if entry is None:
            raise ManageError(f"{root}: no dataset {d}")
        entries.append({"dataset_id": d, "cell_count": entry["cell_count"]})
    os.makedirs(output)
    for root, d in picks:
        source = os.path.abspath(f"{root}/{d}")
        os.symlink(source, f"{output}/{d}") if link else shutil.copytree(source, f"{output}/{d}")
    index = read_index(output) | {"topology": "federated", "datasets": ranged(entries), "total_cells": sum(e["cell_count"] for e in entries)}
    write_yaml(index, Path(output, INDEX))
    return index


def collect_garbage(root: str, dry_run: bool = True) -> list[str]:
    """Folders of datasets that are not registered; deleted unless it is a dry run."""
    index = read_index(root)
    known = {d["dataset_id"] for d in index["datasets"]}
    base = Path(root, "meta") if index["topology"] == "aggregate" else Path(root)
    gone = sorted(str(p) for p in base.iterdir() if p.is_dir() and p.name not in known and (index["topology"] == "aggregate" or (p / "meta").exists() or (p / "matrix").exists())) if base.exists() else []
    for p in gone if not dry_run else []:
        os.unlink(p) if os.path.islink(p) else shutil.rmtree(p)
    return gone
