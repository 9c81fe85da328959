"""Text transforms of the column-mapping language, as functions from Column to Column.

All take text; null counts as "". ``chain`` applies transforms by name; the
literal "NA" stands for a missing value, as in the tables it is used on.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "NA"
# Texts that count as missing (after trimming, in lower case), with and without n/a
MISSING = ("", "na", "n/a", "none", "null", "nan", ".", "-")
MISSING_AT_LOAD = ("", "na", "none", "null", "nan", ".", "-")
# Units by alias
DOSE_UNITS = {"%": "%", "nm": "nm", "nanomolar": "nm", "nanomol": "nm", "um": "um", "micromolar": "um", "mm": "mm", "millimolar": "mm", "mg/kg": "mg/kg", "ug/kg": "ug/kg"}
TIME_UNITS = {"h": "h", "hr": "h", "hrs": "h", "hour": "h", "hours": "h", "d": "d", "day": "d", "days": "d", "m": "m", "min": "m", "mins": "m", "minute": "m", "minutes": "m"}
# patterns
NUMBER = r"([+-]?(?:\d+(?:\.\d+)?|\.\d+))"
DOSE = r"^\s*" + NUMBER + r"\s*([A-Za-zµμ%]+(?:/[A-Za-zµμ%]+)?)\s*$"
TIME = r"^\s*" + NUMBER + r"\s*([A-Za-z]+)\s*$"
BARE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
GUIDE_SUFFIXES = (r"(?i)[_\-\s](sg|guide|grna)\d+$", r"(?i)[_\-]g\d+$", r"(?i)[_\-]\d+$")
ENSEMBL = (r"(?i)^ENS[A-Z]*G\d+", r"(?i)^ENS[A-Z]*T\d+", r"(?i)^WBGene\d+")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_whitespace(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def _micro(c: Column) -> Column:
    return F.translate(c, "μµ", "uu")


def _norm(c: Column, case_sensitive: bool, strip: bool) -> Column:
    c = _micro(strip_whitespace(c) if strip else text(c))
    return c if case_sensitive else F.lower(c)


def _norm_value(v: str, case_sensitive: bool, strip: bool) -> str:
    v = (v.strip() if strip else v).replace("μ", "u").replace("µ", "u")
    return v if case_sensitive else v.lower()


def is_missing(c: Column, words: Sequence[str] = MISSING) -> Column:
    return c.isNull() | F.lower(strip_whitespace(c)).isin(*words)


def null_if_missing(c: Column, words: Sequence[str] = MISSING_AT_LOAD) -> Column:
    return F.when(~is_missing(c, words), c)


def map_control_labels(c: Column, candidates: Sequence[str], output: str = "ctrl", case_sensitive: bool = False, strip_whitespace: bool = True) -> Column:
    known = [_norm_value(v, case_sensitive, strip_whitespace) for v in candidates]
    return F.when(_norm(c, case_sensitive, strip_whitespace).isin(*known), F.lit(output)).otherwise(text(c))


def replace_empty_with_null(c: Column, strip_whitespace: bool = True) -> Column:
    seen = globals()["strip_whitespace"](c) if strip_whitespace else text(c)
    return F.when(seen == "", F.lit(NA)).otherwise(text(c))


def strip_prefix(c: Column, prefix: str) -> Column:
    c = text(c)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    c = text(c)
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - F.lit(len(suffix)))).otherwise(c) if suffix else c


def strip_guide_suffix(c: Column) -> Column:
    c = text(c)
    out = c
    for p in reversed(GUIDE_SUFFIXES):
        out = F.when(c.rlike(p), F.regexp_replace(F.regexp_replace(c, p, ""), r"[_\- ]+$", "")).otherwise(out)
    return out


def regex_sub(c: Column, pattern: str, replacement: str = "") -> Column:
    """Replacement in Python's form: ``\\1`` and ``\\g<1>`` name groups, ``$`` is itself."""
    re.compile(pattern)
    java = replacement.replace("$", r"\$")
    java = re.sub(r"\\g<(\w+)>", lambda m: "$" + (m[1] if m[1].isdigit() else "{" + m[1] + "}"), java)
    java = re.sub(r"(?<!\\)\\(\d)", r"$\1", java)
    return F.regexp_replace(text(c), F.lit(pattern), F.lit(java))


def normalize_case(c: Column, mode: str) -> Column:
    c = text(c)
    if mode == "title":  # a capital after anything that is not a letter
        parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
        return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))), "")
    if mode not in ("lower", "upper"):
        raise ValueError(f"unknown case mode: {mode}")
    return F.lower(c) if mode == "lower" else F.upper(c)


def recognize_control(c: Column, patterns: Sequence[str]) -> Column:
    c = F.lower(text(c))
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("(?i)" + p)
    return out


def join_with_plus(*cs: Column) -> Column:
    return F.array_join(F.filter(F.array(*map(text, cs)), lambda x: x != ""), "+")


def coalesce_values(*cs: Column) -> Column:
    return F.coalesce(*(F.when(~is_missing(c), c.cast("string")) for c in cs), F.lit(NA)) if cs else F.lit(NA)


def split_on_delimiter(c: Column, delimiter: str = ",", part: int = 0) -> Column:
    if not delimiter:
        raise ValueError("the delimiter must not be empty")
    if part < 0:
        return F.lit(NA)
    parts = F.split(text(c), r"\Q" + delimiter + r"\E", -1)
    found = strip_whitespace(F.get(parts, F.lit(int(part))))
    return F.when((found != "") & (F.size(parts) > part), found).otherwise(F.lit(NA))


def map_values(c: Column, mapping: Mapping[str, str]) -> Column:
    c = text(c)
    if not mapping:
        return c
    table = F.create_map(*(F.lit(str(x)) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c)


def _number(c: Column, pattern: str) -> Column:
    v = strip_whitespace(c)
    return F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1)).when(v.rlike(BARE), v).otherwise(F.lit(NA))


def _unit(c: Column, units: Mapping[str, str]) -> Column:
    v = strip_whitespace(c)
    table = F.create_map(*(F.lit(x) for kv in units.items() for x in kv))
    return F.when(v == "", F.lit(NA)).otherwise(F.coalesce(F.try_element_at(table, F.lower(_micro(v))), v))


def dose_parse(c: Column) -> Column:
    return _number(c, DOSE)


def normalize_dose_unit(c: Column) -> Column:
    return _unit(c, DOSE_UNITS)


def dose_unit(c: Column) -> Column:
    v = strip_whitespace(c)
    return F.when(v.rlike(DOSE), normalize_dose_unit(F.regexp_extract(v, DOSE, 2))).otherwise(F.lit(NA))


def timepoint_parse(c: Column) -> Column:
    return _number(c, TIME)


def normalize_time_unit(c: Column) -> Column:
    return _unit(c, TIME_UNITS)


def timepoint_unit(c: Column) -> Column:
    v = strip_whitespace(c)
    return F.when(v.rlike(TIME), normalize_time_unit(F.regexp_extract(v, TIME, 2))).otherwise(F.lit(NA))


def strip_ensembl_version(c: Column) -> Column:
    c = text(c)
    return F.when(F.upper(c).startswith("ENS"), F.regexp_replace(c, r"\.\d+$", "")).otherwise(c)


def normalize_boolean(c: Column, true_output: str = "true", false_output: str = "false", true_values: Sequence[str] = ("1", "t", "true", "y", "yes"), false_values: Sequence[str] = ("0", "f", "false", "n", "no"), case_sensitive: bool = False, strip_whitespace: bool = True) -> Column:
    v = _norm(c, case_sensitive, strip_whitespace)
    yes, no = ([_norm_value(x, case_sensitive, strip_whitespace) for x in values] for values in (true_values, false_values))
    return F.when(v.isin(*yes), F.lit(true_output)).when(v.isin(*no), F.lit(false_output)).otherwise(text(c))


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]", "")


def looks_ensembl(c: Column) -> Column:
    v = strip_whitespace(c)
    return v.rlike("|".join(f"({p})" for p in ENSEMBL))


def looks_versioned(c: Column) -> Column:
    return strip_whitespace(c).rlike(r"(?i)^ENS.*\.\d+$")


def looks_dose(c: Column) -> Column:
    return strip_whitespace(c).rlike(DOSE)


def looks_time(c: Column) -> Column:
    return strip_whitespace(c).rlike(TIME)


def looks_guide(c: Column) -> Column:
    return strip_whitespace(c).rlike("|".join(f"({p})" for p in GUIDE_SUFFIXES))


def member_key(member: str, index: Column) -> Column:
    """Key of a feature that is local to a member: a JSON pair of its name and number."""
    import json

    return F.concat(F.lit("[" + json.dumps(member) + ", "), index.cast("string"), F.lit("]"))


#: transforms that a schema may name; register() adds to them
TRANSFORMS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        map_control_labels, strip_whitespace, replace_empty_with_null, strip_prefix, strip_suffix, strip_guide_suffix, regex_sub, normalize_case, split_on_delimiter,
        map_values, dose_parse, dose_unit, normalize_dose_unit, timepoint_parse, timepoint_unit, normalize_time_unit, strip_ensembl_version, normalize_boolean,
    )
}


def register(name: str, transform: Callable[..., Column]) -> None:
    TRANSFORMS[name] = transform


def chain(c: Column, transforms: Sequence[Mapping], fallback: str = NA) -> Column:
    """Transforms in order; an unknown name is skipped with a warning, bad arguments give the fallback, and so does a missing result."""
    out = text(c)
    for t in transforms:
        f = TRANSFORMS.get(t["name"])
        if f is None:
            warnings.warn(f"unknown transform {t['name']!r} is skipped", stacklevel=2)
            continue
        try:
            out = f(out, **(t.get("args") or {}))
        except Exception:
            return F.lit(fallback)
    return F.when(is_missing(out), F.lit(fallback)).otherwise(out)


def matches(c: Column, operator: str, value=None, case_sensitive: bool = False, strip: bool = True) -> Column:
    """Predicates ``equals``, ``in`` and ``not_null``; null compares as ""."""
    if operator == "not_null":
        return ~is_missing(c)
    if operator not in ("equals", "in"):
        raise ValueError(f"unknown predicate: {operator}")
    values = [value] if operator == "equals" else list(value)
    norm = lambda v: (lambda s: s if case_sensitive else s.lower())(("" if v is None else str(v)).strip() if strip else ("" if v is None else str(v)))
    seen = strip_whitespace(c) if strip else text(c)
    return (seen if case_sensitive else F.lower(seen)).isin(*map(norm, values))
