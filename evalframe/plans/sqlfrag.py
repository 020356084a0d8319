"""DuckDB SQL fragments for the oracle queries (the same rules written as SQL)."""

from __future__ import annotations

from evalframe.functions.constants import (GOLD_POSITIVE, PY_WHITESPACE,
                                           VERDICT_NEGATIVE_CUES,
                                           VERDICT_POSITIVE_CUES)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(PY_WHITESPACE)})"


def pystr(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def verdict(x: str) -> str:
    n = f"replace(replace(upper(coalesce({x}, '')), ' ', '_'), '-', '_')"
    neg = " OR ".join(f"contains({n}, {lit(c)})" for c in VERDICT_NEGATIVE_CUES)
    pos = " OR ".join(f"contains({n}, {lit(c)})" for c in VERDICT_POSITIVE_CUES)
    return f"(CASE WHEN {neg} THEN 'NOT_SUPPORTED' WHEN {pos} THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END)"


def gold(x: str) -> str:
    s = strip(x)
    syn = ", ".join(lit(g) for g in GOLD_POSITIVE)
    return (f"(CASE WHEN {x} IS NULL THEN 'NOT_SUPPORTED' WHEN regexp_full_match({s}, '0+') THEN 'SUPPORTED' "
            f"WHEN regexp_full_match({s}, '[0-9]+') THEN 'NOT_SUPPORTED' "
            f"WHEN replace(upper({s}), ' ', '_') IN ({syn}) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END)")


def sentences(evidence: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({evidence}, ''), '.'), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def claim_input(claim: str, evidence: str) -> str:
    numbered = f"array_to_string(list_transform({sentences(evidence)}, lambda s, i: CAST(i AS VARCHAR) || '. ' || s), chr(10))"
    return f"('Claim: ' || {pystr(claim)} || chr(10) || chr(10) || 'Context:' || chr(10) || {numbered})"


def label_match(p: str, g: str) -> str:
    return f"coalesce(upper({strip(p)}) = upper({strip(g)}), false)"


def preview(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def pct_string(num: str, den: str, signed: bool = False) -> str:
    v = (f"(CASE WHEN ({den}) = 0 THEN 0 ELSE CAST(floor((abs({num}) * 20000 + abs({den})) / (abs({den}) * 2)) AS BIGINT) END)")
    neg = f"((({num}) < 0) <> (({den}) < 0))"
    plus = "'+'" if signed else "''"
    return (f"((CASE WHEN {neg} AND {v} > 0 THEN '-' ELSE {plus} END) || CAST({v} // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST({v} % 100 AS VARCHAR), 2, '0') || '%')")

