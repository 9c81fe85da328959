"""Drafts of a harmonisation schema from column names and, where there are some, sample values."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping as Map
from collections.abc import Sequence

from pyspark.sql import DataFrame

from matrixlake.functions import text as X
from matrixlake.plans.canonical import Mapping, Schema
from matrixlake.schema import OBS_REQUIRED, VAR_REQUIRED

# Raw column names by harmonised column, likeliest first
OBS_ALIASES = {
    "assay": "assay protocol technology platform assay_type",
    "batch_id": "batch batch_id batch_name sample_batch library_batch sequencing_batch plate_id pool_id",
    "cell_context": "cell_type cell_context cluster cell_ontology cell_label cell_type_label celltype",
    "cell_id": "cell_id cell_barcode barcode cell_name cell_bc barcode_sequence",
    "cell_line_or_type": "cellline cell_line cell_line_or_type cell_line_name line cell_line_id",
    "condition": "genotype condition genetic_background background strain genetic_condition",
    "dataset_id": "dataset_id study_id dataset source_dataset",
    "disease_state": "disease_state disease health_status condition_status pathology disease_status",
    "donor_id": "donor_id donor subject_id patient_id sample_donor_id individual_id",
    "dose": "dose concentration amount dose_value dosage dose_concentration",
    "dose_unit": "dose_unit concentration_unit unit dosage_unit",
    "perturb_label": "guide_1 perturb_label guide sgrna guide_id perturbation perturbation_name target_gene target_label",
    "perturb_type": "treatment perturb_type perturbation_type intervention_type moa treatment_type intervention",
    "sex": "sex gender biological_sex",
    "species": "species organism source_organism",
    "timepoint": "timepoint time treatment_time exposure_time duration time_point",
    "timepoint_unit": "timepoint_unit time_unit duration_unit",
    "tissue": "tissue organ tissue_type source_tissue",
}
VAR_ALIASES = {"origin_index": "origin_index index row_index feature_index", "gene_id": "feature_id gene_id gene gene_name gene_symbol symbol feature_name gene_identifier"}
LITERALS = {"dataset_index": "0", "species": "human", "tissue": "unknown", "assay": "unknown", "disease_state": "healthy", "sex": "unknown"}
FALLBACKS = {"cell_context": "unknown", "cell_line_or_type": "unknown", "donor_id": "unknown", "condition": "WT", "perturb_type": "untreated"}
ROW_NUMBERS = ("global_row_index", "local_row_index")
SAMPLES = 50


def _key(name: str) -> str:
    return re.sub(r"[^0-9a-z]", "", name.lower())


def find_column(canonical: str, columns: Sequence[str], aliases: Map[str, str] = OBS_ALIASES) -> str | None:
    """The raw column for a harmonised one: by name, name without signs, alias, an alias inside a name, the name inside a name."""
    if canonical in columns:
        return canonical
    by_key = {}
    for c in columns:
        by_key.setdefault(_key(c), c)
    if _key(canonical) in by_key:
        return by_key[_key(canonical)]
    names = aliases.get(canonical, "").split()
    for a in names:
        if _key(a) in by_key:
            return by_key[_key(a)]
    for a in [*names, canonical]:
        for c in columns:
            if len(_key(a)) > 3 and _key(a) in _key(c):
                return c
    return None


def samples_of(df: DataFrame, n: int = SAMPLES) -> dict[str, list[str]]:
    """Up to n values of each column that are not missing, from the first rows."""
    out: dict[str, list[str]] = {c: [] for c in df.columns}
    for row in df.limit(4 * n).collect():
        for c in df.columns:
            v = row[c]
            if v is not None and str(v).strip().lower() not in X.MISSING and len(out[c]) < n:
                out[c].append(str(v))
    return out


def _like(pattern: str, values: Sequence[str]) -> float:
    return sum(bool(re.search(pattern, v.strip())) for v in values) / len(values) if values else 0.0


def suggest_transforms(canonical: str, values: Sequence[str]) -> list[dict]:
    out = [{"name": "strip_whitespace", "args": {}}]
    with_unit = {"dose": X.DOSE, "dose_unit": X.DOSE, "timepoint": X.TIME, "timepoint_unit": X.TIME}
    parse = {"dose": "dose_parse", "dose_unit": "dose_unit", "timepoint": "timepoint_parse", "timepoint_unit": "timepoint_unit"}
    if canonical in with_unit and _like(with_unit[canonical], values) > 0.5:
        return [*out, {"name": parse[canonical], "args": {}}]
    if canonical in ("dose_unit", "timepoint_unit"):
        out.append({"name": "normalize_dose_unit" if canonical == "dose_unit" else "normalize_time_unit", "args": {}})
    if canonical == "perturb_label":
        if any(re.search(p, v.strip()) for p in X.GUIDE_SUFFIXES for v in values):
            out.append({"name": "strip_guide_suffix", "args": {}})
        strong = [v for v in dict.fromkeys(v.strip() for v in values) if _key(v) in _STRONG]
        if strong:
            out.append({"name": "map_control_labels", "args": {"candidates": strong, "output": "ctrl"}})
    return out


_STRONG = {"ctrl", "control", "ntc", "nontargeting", "nonperturbing", "nonperturbed", "scramble", "scrambled"}


def complementary(df_samples: Map[str, Sequence[str | None]], a: str, b: str) -> bool:
    """Whether two columns of aligned values fill each other's gaps."""
    gap = lambda v: v is None or str(v).strip().lower() in X.MISSING
    pairs = list(zip(df_samples[a], df_samples[b], strict=False))
    return any(gap(x) and not gap(y) for x, y in pairs) and any(gap(y) and not gap(x) for x, y in pairs)


def gene_mapping_for(values: Sequence[str]) -> dict:
    ensembl = _like("|".join(f"(?:{p[4:]})" for p in X.ENSEMBL), [v.upper() for v in values]) > 0.5
    return {"enabled": ensembl, "engine": "gget" if ensembl else "identity", "source_namespace": "ensembl" if ensembl else "gene_symbol", "target_namespace": "gene_symbol", "mapping_file": None}


def draft(dataset_id: str, obs_columns: Sequence[str], var_columns: Sequence[str], samples: Map[str, Sequence[str]] | None = None, var_samples: Map[str, Sequence[str]] | None = None, aligned: Map[str, Sequence[str | None]] | None = None) -> Schema:
    """A schema to be reviewed; its notes say what was matched and what was not."""
    samples, var_samples, notes, obs = samples or {}, var_samples or {}, [], []
    for name in OBS_REQUIRED:
        if name in ROW_NUMBERS:
            obs.append(Mapping(name, "row-index"))
            continue
        column = find_column(name, obs_columns) if name != "dataset_index" else None
        if column is None:
            if name in LITERALS:
                obs.append(Mapping(name, "literal", literal_value=LITERALS[name]))
                notes.append(f"{name}: no column; literal {LITERALS[name]}")
            else:
                obs.append(Mapping(name, "null", fallback=FALLBACKS.get(name, X.NA)))
                notes.append(f"{name}: no column; null")
            continue
        transforms = tuple(suggest_transforms(name, samples.get(column, ())))
        fallback = FALLBACKS.get(name, X.NA)
        other = None
        if name == "perturb_label" and aligned:
            candidates = [c for c in obs_columns if c != column and _key(c) in {_key(a) for a in OBS_ALIASES[name].split()} and c in aligned]
            other = next((c for c in candidates if column in aligned and complementary(aligned, column, c)), None)
        if other:
            obs.append(Mapping(name, "coalesce", source_columns=(column, other), transforms=transforms, fallback=fallback))
            notes.append(f"{name}: {column} and {other} fill each other's gaps")
        else:
            obs.append(Mapping(name, "source-field", source_column=column, transforms=transforms, fallback=fallback))
            notes.append(f"{name}: column {column}")
    gene = find_column("gene_id", var_columns, VAR_ALIASES) or "feature_id"
    values = var_samples.get(gene, ())
    strip = ({"name": "strip_ensembl_version", "args": {}},) if _like(r"^ENS.*\.\d+$", [v.upper() for v in values]) > 0.5 else ()
    var = [Mapping("origin_index", "passthrough"), Mapping("gene_id", "source-field", source_column=gene, transforms=strip), Mapping("canonical_gene_id", "gene-mapping"), Mapping("global_id", "auto")]
    assert {m.canonical_name for m in var} == set(VAR_REQUIRED)
    return Schema(dataset_id, obs, var, gene_mapping=gene_mapping_for(values), status="draft", description=f"Draft for {dataset_id}.", notes=notes)


def majority(values: Sequence[str]) -> str | None:
    return Counter(values).most_common(1)[0][0] if values else None
