"""Grammar profiles by dialect and version: which one reads a database's statements, and what its version doesn't know."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What newer versions brought, and how it shows in a statement (strings and comments left out).
FEATURES = {
    "cte": r"\bWITH\s+(?:RECURSIVE\s+)?\w+\s*(?:\([^)]*\)\s*)?AS\s*\(", "window": r"\)\s*OVER\s*(?:\(|\w)", "lateral": r"\bLATERAL\b", "intersect_except": r"\b(?:INTERSECT|EXCEPT)\b", "json_table": r"\bJSON_TABLE\s*\(",
    "temporal_key": r"\bWITHOUT\s+OVERLAPS\b|\bPERIOD\s+\w+\s*\)", "merge_returning": r"\bMERGE\s+INTO\b.*\bRETURNING\b", "boolean": r"\bBOOLEAN\b", "table_values": r"\bFROM\s*\(\s*VALUES\b", "if_exists": r"\b(?:CREATE|DROP)\s+TABLE\s+IF\s+(?:NOT\s+)?EXISTS\b",
    "string_agg": r"\bSTRING_AGG\s*\(", "greatest": r"\b(?:GREATEST|LEAST)\s*\(", "window_clause": r"\bWINDOW\s+\w+\s+AS\s*\(", "is_distinct": r"\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b", "regexp": r"\bREGEXP_LIKE\s*\(", "match_partial": r"\bANY_VALUE\s*\(",
}


@dataclass(frozen=True)
class Profile:
    id: str
    dialect: str
    version: tuple[int, int]
    lacks: frozenset[str] = frozenset()


def _p(dialect: str, name: str, version: tuple[int, int], *lacks: str) -> Profile:
    return Profile(f"{dialect}-{name}", dialect, version, frozenset(lacks))


PROFILES = (
    _p("mysql", "5.7", (5, 7), "cte", "window", "lateral", "intersect_except", "json_table", "window_clause"), _p("mysql", "8.0", (8, 0)),
    _p("postgres", "16", (16, 0), "json_table", "merge_returning", "temporal_key"), _p("postgres", "17", (17, 0), "temporal_key"), _p("postgres", "18", (18, 0)),
    _p("oracle", "12c", (12, 0), "boolean", "table_values", "if_exists", "match_partial"), _p("oracle", "19c", (19, 0), "boolean", "table_values", "if_exists"), _p("oracle", "21c", (21, 0), "boolean", "table_values", "if_exists"), _p("oracle", "26ai", (26, 0)),
    _p("sqlserver", "2016", (2016, 0), "string_agg", "greatest", "window_clause", "is_distinct", "regexp"), _p("sqlserver", "2017", (2017, 0), "greatest", "window_clause", "is_distinct", "regexp"),
    _p("sqlserver", "2019", (2019, 0), "greatest", "window_clause", "is_distinct", "regexp"), _p("sqlserver", "2022", (2022, 0), "regexp"), _p("sqlserver", "2025", (2025, 0)),
)
#: SQL Server's version numbers are not its years.
YEARS = {13: 2016, 14: 2017, 15: 2019, 16: 2022, 17: 2025}
QUIET = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", re.S)


def select(dialect: str, version: str = "") -> tuple[Profile | None, str]:
    """(profile, reason): a profile's own name wins; else the newest profile of the same major version that isn't newer; else the one of the nearest older major version; else none, and the tolerant grammar reads alone."""
    own = [p for p in PROFILES if p.dialect == dialect]
    for p in own:
        if version.lower() in (p.id, p.id.partition("-")[2]):
            return p, "EXACT"
    m = re.match(r"\D*(\d+)(?:\.(\d+))?", version)
    if not own or not m:
        return None, "NO_VERSION" if own else "NO_DIALECT"
    major, minor = int(m.group(1)), int(m.group(2) or 0)
    major = YEARS.get(major, major) if dialect == "sqlserver" else major
    same = [p for p in own if p.version[0] == major]
    if same:
        return max([p for p in same if p.version[1] <= minor] or same, key=lambda p: p.version), "SAME_MAJOR"
    older = [p for p in own if p.version[0] < major]
    return (max(older, key=lambda p: p.version), "OLDER_MAJOR") if older else (None, "TOO_OLD")


def unknown_features(sql: str, profile: Profile | None) -> list[str]:
    """What the statement uses that the profile's version doesn't know; nothing without a profile."""
    if profile is None or not profile.lacks:
        return []
    text = QUIET.sub("''", sql)
    return sorted(f for f in profile.lacks if re.search(FEATURES[f], text, re.I | re.S))
