"""Privacy: which columns go, which values become null, and a report of both."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.exprs import KEY, num

# Patterns of names and of values, metadata columns, thresholds
SENSITIVE_NAMES = (re.compile("uuid", re.I), re.compile("userProfilePK", re.I))
GUID = r"^[0-9a-fA-F-]{32,}$"
STRESS_LEVEL = re.compile(r"(?:^|_)averageStressLevel(?:Intensity)?$")
METADATA = ("version", "source")
GUID_SAMPLE, GUID_FEW, GUID_SHARE = 200, 5, 0.8


def sensitive_name(name: str) -> bool:
    low = name.lower()
    if any(p.search(name) for p in SENSITIVE_NAMES):
        return True
    own_key = low.endswith("pk") or low.startswith("pk_") or "_pk" in low
    return own_key and ("user" in low or "profile" in low)


def nested_date(name: str) -> bool:
    return name.lower().endswith(("_calendardate", "_calendardatestr"))


def stress_level(name: str) -> bool:
    return name == "avgSleepStress" or bool(STRESS_LEVEL.search(name))


def guid_columns(df: DataFrame) -> list[str]:
    """Text columns whose first known values look like GUIDs: all of fewer than five, else four
    fifths. "First" is by the day, if there is one. One job a text column: the smallest GUID_SAMPLE of
    (day, value), of which each task keeps as many, and an aggregate over them."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != KEY]
    found = []
    for name in texts:
        rows = df.where(F.col(name).isNotNull()).orderBy(*([KEY] if KEY in df.columns else []), name).limit(GUID_SAMPLE)
        n, hits = rows.agg(F.count("*"), F.count_if(F.col(name).rlike(GUID))).first()
        if n and (hits == n if n < GUID_FEW else hits / n >= GUID_SHARE):
            found.append(name)
    return found


def null_stress_levels(df: DataFrame, count: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Levels outside 0 to 100 are sentinels and become null; how many, by column, from one aggregate."""
    names = [c for c in df.columns if stress_level(c)]
    if not names:
        return df, {}
    off = {c: (num(c) < 0) | (num(c) > 100) for c in names}
    counts = df.agg(*[F.count_if(x).alias(c) for c, x in off.items()]).first().asDict() if count else {}
    return df.withColumns({c: F.when(~F.coalesce(x, F.lit(False)), F.col(c)) for c, x in off.items()}), {c: n for c, n in counts.items() if n}


def sanitize(df: DataFrame, keep: Iterable[str] = (), drop: Iterable[str] = (), allow_identifiers: bool = False) -> tuple[DataFrame, dict[str, Any]]:
    """``keep`` rescues metadata and nested dates (anything, where identifiers are allowed);
    ``drop`` wins over it; the day always stays and comes first."""
    keep, drop, rules = set(keep), set(drop), []
    others = [c for c in df.columns if c != KEY]
    by_name = {c for c in others if sensitive_name(c)}
    by_value = set() if allow_identifiers else set(guid_columns(df))
    metadata, dates = {c for c in others if c in METADATA}, {c for c in others if nested_date(c)}
    for found, rule in ((by_name, "drop_sensitive_columns_by_name"), (by_value, "drop_guid_like_value_columns"), (metadata, "drop_redundant_metadata_columns"), (dates, "drop_nested_calendarDate_duplicates"), (keep, "apply_keep_exceptions"), (drop, "apply_explicit_drop_list")):
        if found:
            rules.append(rule)
    identifiers = set() if allow_identifiers else by_name | by_value
    gone = (identifiers | ((metadata | dates) - keep) | drop) - {KEY}
    kept = [c for c in ([KEY] if KEY in df.columns else []) + others if c not in gone]
    out, replaced = null_stress_levels(df.select(*kept))
    report: dict[str, Any] = {"dropped_columns": sorted(gone), "kept_columns": kept, "rules_applied": rules}
    if replaced:
        rules.append("normalize_stress_levels_out_of_range_to_null")
        report["value_replacements"] = {"rule": "stress_levels_must_be_in_0_100", "replaced_to_null_by_column": dict(sorted(replaced.items()))}
    return out, report
