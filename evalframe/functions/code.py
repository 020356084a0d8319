"""Column expressions over generated code: fence extraction, signatures, statuses, guidance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions.constants import (DEFAULT_GUIDANCE, ERROR_GUIDANCE,
                                           STATUS_FAILED, STATUS_IMPORT,
                                           STATUS_LLM, STATUS_PASSED,
                                           STATUS_RUNTIME, STATUS_SYNTAX,
                                           STATUS_TIMEOUT)
from evalframe.functions.text import col_of, py_strip

FENCE = "```"
PY_FENCE = "```python"


def _locate(sub: str, s: Column, pos: Column | None = None) -> Column:
    if pos is None:
        return F.locate(sub, s)
    return F.call_function("locate", F.lit(sub), s, pos)


def extract_code(reply) -> Column:
    """Code from a model reply.

    The first ```python block wins; else the first ``` block, dropping a first
    line that is ``python``/``py``/blank; an unclosed fence or no fence gives
    the whole stripped reply.
    """
    r = py_strip(F.coalesce(col_of(reply), F.lit("")))
    p = _locate(PY_FENCE, r)
    p_start = p + len(PY_FENCE)
    p_end = _locate(FENCE, r, p_start)
    py_block = py_strip(r.substr(p_start, p_end - p_start))

    q = _locate(FENCE, r)
    q_start = q + len(FENCE)
    q_end = _locate(FENCE, r, q_start)
    body = py_strip(r.substr(q_start, q_end - q_start))
    first = F.substring_index(body, "\n", 1)
    rest = F.when(body.contains("\n"), body.substr(F.length(first) + 2, F.length(body))).otherwise(F.lit(""))
    plain_block = py_strip(F.when(py_strip(first).isin("python", "py", ""), rest).otherwise(body))

    return (F.when((p > 0) & (p_end > 0), py_block)
             .when((q > 0) & (q_end > 0), plain_block)
             .otherwise(r))


def signature_line(prompt) -> Column:
    """First line (of the stripped prompt) that starts with ``def `` after stripping; else ''."""
    lines = F.split(py_strip(F.coalesce(col_of(prompt), F.lit(""))), "\n")
    hit = F.filter(lines, lambda ln: py_strip(ln).startswith("def "))
    return F.coalesce(py_strip(F.get(hit, 0)), F.lit(""))


def docstring_block(prompt) -> Column:
    """First closed triple-quoted block, quotes included; ``\"\"\"`` is tried before ``'''``."""
    p = F.coalesce(col_of(prompt), F.lit(""))

    def block(marker: str) -> Column:
        s = _locate(marker, p)
        e = _locate(marker, p, s + 3)
        return F.when((s > 0) & (e > 0), p.substr(s, e - s + 3))

    return F.coalesce(block('"""'), block("'''"), F.lit(""))


def missing_function(code, entry_point) -> Column:
    """True when the entry point name is not a substring of the code (an empty name is always present)."""
    return ~F.coalesce(col_of(code), F.lit("")).contains(F.coalesce(col_of(entry_point), F.lit("")))


def status_of(passed, error_type) -> Column:
    """Execution status from the pass flag and error type (six outcomes plus llm_error)."""
    e = col_of(error_type)
    return (F.when(F.coalesce(col_of(passed), F.lit(False)), F.lit(STATUS_PASSED))
             .when(e == "SyntaxError", F.lit(STATUS_SYNTAX))
             .when(e == "ImportError", F.lit(STATUS_IMPORT))
             .when(e == "TimeoutError", F.lit(STATUS_TIMEOUT))
             .when(e == "LLMError", F.lit(STATUS_LLM))
             .when(e.isin("AssertionError", "MissingFunction", "NoTestCode"), F.lit(STATUS_FAILED))
             .otherwise(F.lit(STATUS_RUNTIME)))


def _guidance_case(status, error_type, rules, pick_key: bool) -> Column:
    s = F.lower(F.coalesce(col_of(status), F.lit("")))
    e = F.lower(F.coalesce(col_of(error_type), F.lit("")))
    out = None
    for key, text in rules:
        k = key.lower()
        cond = s.contains(k) | e.contains(k)
        val = F.lit(key if pick_key else text)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    default = F.lit("default" if pick_key else DEFAULT_GUIDANCE)
    return default if out is None else out.otherwise(default)


def guidance(status, error_type, rules=ERROR_GUIDANCE) -> Column:
    """First-match guidance text: a key contained in status or error type, rules in order.

    The rule list is small and fixed, so the lookup is a CASE expression evaluated
    inside the scan (no join). A null error type is read as empty.
    """
    return _guidance_case(status, error_type, rules, pick_key=False)


def guidance_key(status, error_type, rules=ERROR_GUIDANCE) -> Column:
    return _guidance_case(status, error_type, rules, pick_key=True)
