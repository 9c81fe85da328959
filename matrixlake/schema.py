"""Fixed names and types: the contract of harmonised tables, routing columns, stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

CONTRACT_VERSION = "0.3.0"

# Columns of harmonised cell and feature tables
OBS_REQUIRED = (
    "assay", "batch_id", "cell_context", "cell_id", "cell_line_or_type", "condition", "dataset_id", "dataset_index", "disease_state", "donor_id", "dose",
    "dose_unit", "global_row_index", "local_row_index", "perturb_label", "perturb_type", "sex", "species", "timepoint", "timepoint_unit", "tissue",
)
VAR_REQUIRED = ("origin_index", "gene_id", "canonical_gene_id", "global_id")
OBS_INTEGERS = {"global_row_index": "bigint", "dataset_index": "int", "local_row_index": "bigint"}
OBS_NULLABLE = ("dose", "dose_unit", "timepoint", "timepoint_unit")
ROUTING = ("global_row_index", "dataset_index", "dataset_id", "local_row_index", "cell_id")
INDEX_ORDER = (
    "global_row_index", "cell_id", "dataset_id", "dataset_index", "local_row_index", "perturb_label", "perturb_type", "dose", "dose_unit", "timepoint",
    "timepoint_unit", "cell_context", "cell_line_or_type", "species", "tissue", "assay", "condition", "batch_id", "donor_id", "sex", "disease_state",
)

COO = T.StructType([T.StructField("row", T.LongType()), T.StructField("gene", T.IntegerType()), T.StructField("value", T.DoubleType())])


def expression(count_type: T.DataType = T.IntegerType()) -> T.StructType:
    return T.StructType([T.StructField("global_row_index", T.LongType()), T.StructField("genes", T.ArrayType(T.IntegerType(), False)), T.StructField("counts", T.ArrayType(count_type, False))])
