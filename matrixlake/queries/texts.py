"""Text transforms and predicates: each on a column that has its cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixlake.functions import text as X
from matrixlake.queries.data import table

# messy values made of the tables' columns; the same expressions in both engines' SQL
_SOURCES = {
    "labels": ("orders", "o_orderkey", "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '  Non-Targeting ' WHEN 1 THEN 'NTC' WHEN 2 THEN concat('GENE', o_custkey, '_sg', o_orderkey % 9) WHEN 3 THEN concat('TP53-', o_orderkey % 5) WHEN 4 THEN '' WHEN 5 THEN ' n/a' ELSE o_orderpriority END"),
    "doses": ("orders", "o_orderkey", "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat(o_custkey, 'nM') WHEN 1 THEN concat(' ', o_custkey % 90, '.5 uM ') WHEN 2 THEN '10 mg/kg' WHEN 3 THEN 'unknown' WHEN 4 THEN concat(o_custkey, ' hr') WHEN 5 THEN '3 days' WHEN 6 THEN '1e5' ELSE CAST(o_custkey AS STRING) END"),
    "units": ("orders", "o_orderkey", "CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'nM' WHEN 1 THEN 'nanomolar' WHEN 2 THEN ' uM' WHEN 3 THEN 'Hours' WHEN 4 THEN 'mins' WHEN 5 THEN 'days' WHEN 6 THEN '' WHEN 7 THEN 'MG/KG' ELSE 'furlong' END"),
    "names": ("customer", "c_custkey", "concat(lower(c_name), ' of-the ', c_mktsegment)"),
    "ids": ("part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN concat('ENSG', p_partkey, '.', p_size) WHEN p_partkey % 3 = 1 THEN concat('ensg', p_partkey) ELSE concat('AC', p_partkey, '.1') END"),
    "flags": ("orders", "o_orderkey", "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Yes' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'FALSE' WHEN 3 THEN 't' WHEN 4 THEN 'maybe' ELSE NULL END"),
    "lists": ("part", "p_partkey", "concat(p_name, '+', p_type, CASE WHEN p_size > 25 THEN '+ x ' ELSE '+' END)"),
}


def _source(spark, d, name: str) -> DataFrame:
    t, k, e = _SOURCES[name]
    return table(spark, d, t).select(F.col(k).alias("key"), F.expr(e).alias("v"))


def _duck(name: str) -> str:
    t, k, e = _SOURCES[name]
    return f"(SELECT {k} AS key, {e.replace('AS STRING', 'AS VARCHAR').replace('AS INT)', 'AS INTEGER)')} AS v FROM {t})"


def _q(source: str, column, sql: str):
    def run(spark, d) -> DataFrame:
        return _source(spark, d, source).select("key", column(F.col("v")).alias("out"))

    return run, f"SELECT key, {sql} AS out FROM (SELECT key, coalesce(v, '') AS v, v AS raw FROM {_duck(source)}) s"


_STRIP = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
_LOW = f"lower({_STRIP})"
_MISSING = f"{_LOW} IN ('', 'na', 'n/a', 'none', 'null', 'nan', '.', '-')"
_NUM = "([+-]?(?:\\d+(?:\\.\\d+)?|\\.\\d+))"
_DOSE = f"^\\s*{_NUM}\\s*([A-Za-z%]+(?:/[A-Za-z%]+)?)\\s*$"
_TIME = f"^\\s*{_NUM}\\s*([A-Za-z]+)\\s*$"
_BARE = "^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity|nan)$"


def _case(table_: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END"


def _number(p: str) -> str:
    return f"CASE WHEN regexp_matches({_STRIP}, '{p}') THEN regexp_extract({_STRIP}, '{p}', 1) WHEN regexp_matches({_STRIP}, '{_BARE}') THEN {_STRIP} ELSE 'NA' END"


def _unit(v: str, units: dict) -> str:
    return f"CASE WHEN {v} = '' THEN 'NA' ELSE {_case(units, f'lower({v})', v)} END"


_GUIDES = [("(?i)[_\\-\\s](sg|guide|grna)\\d+$",), ("(?i)[_\\-]g\\d+$",), ("(?i)[_\\-]\\d+$",)]
_GUIDE = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN regexp_replace(regexp_replace(v, '{p}', ''), '[_\\- ]+$', '')" for (p,) in _GUIDES) + " ELSE v END"
_CONTROL = f"CASE WHEN {_LOW} IN ('ntc', 'non-targeting') THEN 'ctrl' ELSE v END"
_TITLE = "list_aggregate(list_transform(regexp_extract_all(v, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '')"

QUERIES = {
    "xf_map_control_labels": _q("labels", lambda v: X.map_control_labels(v, ["NTC", "non-targeting"]), _CONTROL),
    "xf_strip_whitespace": _q("labels", X.strip_whitespace, _STRIP),
    "xf_replace_empty_with_null": _q("labels", X.replace_empty_with_null, f"CASE WHEN {_STRIP} = '' THEN 'NA' ELSE v END"),
    "xf_strip_prefix": _q("labels", lambda v: X.strip_prefix(v, "GENE"), "CASE WHEN starts_with(v, 'GENE') THEN substr(v, 5) ELSE v END"),
    "xf_strip_suffix": _q("labels", lambda v: X.strip_suffix(v, "_sg1"), "CASE WHEN ends_with(v, '_sg1') THEN left(v, length(v) - 4) ELSE v END"),
    "xf_strip_guide_suffix": _q("labels", X.strip_guide_suffix, _GUIDE),
    "xf_regex_sub": _q("labels", lambda v: X.regex_sub(v, r"([A-Z]+)(\d+)", r"\2$\g<1>"), "regexp_replace(v, '([A-Z]+)(\\d+)', '\\2$\\1', 'g')"),
    "xf_normalize_case": _q("names", lambda v: X.normalize_case(v, "title"), _TITLE),
    "xf_normalize_case_upper": _q("names", lambda v: X.normalize_case(v, "upper"), "upper(v)"),
    "xf_recognize_control": _q("labels", lambda v: X.recognize_control(v, ["^ntc", "non.?targ"]), "regexp_matches(lower(v), '^ntc') OR regexp_matches(lower(v), 'non.?targ')"),
    "xf_join_with_plus": _q("labels", lambda v: X.join_with_plus(v, F.lit("x"), F.lit(None)), "CASE WHEN v = '' THEN 'x' ELSE v || '+x' END"),
    "xf_coalesce_values": _q("labels", lambda v: X.coalesce_values(v, F.lit("none"), F.lit("other")), f"CASE WHEN {_MISSING} THEN 'other' ELSE v END"),
    "xf_split_on_delimiter": _q("lists", lambda v: X.split_on_delimiter(v, "+", 2), "CASE WHEN trim(split_part(v, '+', 3)) = '' THEN 'NA' ELSE trim(split_part(v, '+', 3)) END"),
    "xf_map_values": _q("units", lambda v: X.map_values(v, {"nM": "nano", "days": "d"}), _case({"nM": "nano", "days": "d"}, "v", "v")),
    "xf_dose_parse": _q("doses", X.dose_parse, _number(_DOSE)),
    "xf_dose_unit": _q("doses", X.dose_unit, f"CASE WHEN regexp_matches({_STRIP}, '{_DOSE}') THEN {_unit(f'regexp_extract({_STRIP}, {chr(39)}{_DOSE}{chr(39)}, 2)', X.DOSE_UNITS)} ELSE 'NA' END"),
    "xf_normalize_dose_unit": _q("units", X.normalize_dose_unit, _unit(_STRIP, X.DOSE_UNITS)),
    "xf_timepoint_parse": _q("doses", X.timepoint_parse, _number(_TIME)),
    "xf_timepoint_unit": _q("doses", X.timepoint_unit, f"CASE WHEN regexp_matches({_STRIP}, '{_TIME}') THEN {_unit(f'regexp_extract({_STRIP}, {chr(39)}{_TIME}{chr(39)}, 2)', X.TIME_UNITS)} ELSE 'NA' END"),
    "xf_normalize_time_unit": _q("units", X.normalize_time_unit, _unit(_STRIP, X.TIME_UNITS)),
    "xf_strip_ensembl_version": _q("ids", X.strip_ensembl_version, "CASE WHEN upper(v) LIKE 'ENS%' THEN regexp_replace(v, '\\.\\d+$', '') ELSE v END"),
    "xf_normalize_boolean": _q("flags", X.normalize_boolean, f"CASE WHEN {_LOW} IN ('1', 't', 'true', 'y', 'yes') THEN 'true' WHEN {_LOW} IN ('0', 'f', 'false', 'n', 'no') THEN 'false' ELSE v END"),
    "xf_null_like": _q("labels", X.is_missing, _MISSING),
    "xf_label_key": _q("labels", X.label_key, "regexp_replace(lower(v), '[^a-z0-9]', '', 'g')"),
    "xf_looks": _q("ids", X.looks_ensembl, "regexp_matches(v, '(?i)^ENS[A-Z]*[GT]\\d+')"),
    "xf_member_key": _q("ids", lambda v: X.member_key("a", F.length(v)), "'[\"a\", ' || length(v) || ']'"),
    "xf_chain": _q(
        "labels",
        lambda v: X.chain(v, [{"name": "strip_whitespace"}, {"name": "strip_guide_suffix"}, {"name": "map_control_labels", "args": {"candidates": ["ntc", "non-targeting"]}}], "none given"),
        f"(SELECT CASE WHEN {_MISSING} THEN 'none given' ELSE v END FROM (SELECT {_CONTROL} AS v FROM (SELECT {_GUIDE} AS v FROM (SELECT {_STRIP} AS v FROM (SELECT s.v AS v)))))",
    ),
    "predicates": _q(
        "labels",
        lambda v: F.concat_ws(",", *(x.cast("string") for x in (X.matches(v, "equals", " ntc "), X.matches(v, "in", ["NTC", ""]), X.matches(v, "not_null"), X.matches(v, "equals", "ntc", case_sensitive=True)))),
        f"concat_ws(',', CAST({_LOW} = 'ntc' AS VARCHAR), CAST({_LOW} IN ('ntc', '') AS VARCHAR), CAST(NOT ({_MISSING}) AS VARCHAR), CAST({_STRIP} = 'ntc' AS VARCHAR))",
    ),
}
