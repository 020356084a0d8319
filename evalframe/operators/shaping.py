"""Shaping: raw examples to the common (input, answer, context) shape, requests, few-shot parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.code import docstring_block, signature_line
from evalframe.functions.constants import (FEWSHOT_REQUEST_EXAMPLE,
                                           FEWSHOT_REQUEST_FOOTER,
                                           FEWSHOT_REQUEST_HEADER, LABELS)
from evalframe.functions.text import col_of, py_str, py_strip
from evalframe.functions.verdicts import normalize_gold


def split_evidence(evidence) -> Column:
    """Evidence -> sentence list.

    Strings split on every '.', items stripped, empties dropped (``3.14`` becomes
    two items, as in the source behaviour); arrays are stripped and filtered.
    Null gives an empty list.
    """
    e = col_of(evidence)
    return F.filter(F.transform(F.split(F.coalesce(e, F.lit("")), r"\.", -1), lambda s: py_strip(s)),
                    lambda s: s != "")


def split_evidence_array(evidence) -> Column:
    return F.filter(F.transform(F.coalesce(col_of(evidence), F.array().cast("array<string>")),
                                lambda s: py_strip(s)), lambda s: s != "")


def number_sentences(sentences) -> Column:
    """``1. first\\n2. second`` ..."""
    return F.array_join(F.transform(col_of(sentences), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def format_claims(df: DataFrame, key: str = "claim_id", claim: str = "claim", evidence: str = "evidence",
                  label: str = "label_raw") -> DataFrame:
    """Raw claims -> ``input = "Claim: ...\\n\\nContext:\\n1. ..."`` and a normalised ``answer``."""
    ev_type = df.schema[evidence].dataType.simpleString()
    sentences = split_evidence_array(evidence) if ev_type.startswith("array") else split_evidence(evidence)
    # the sentences are split once, in a step of their own
    split = df.select(key, claim, label, sentences.alias("_ef_s"))
    return split.select(
        F.col(key),
        F.concat(F.lit("Claim: "), py_str(F.col(claim)), F.lit("\n\nContext:\n"), number_sentences("_ef_s")).alias("input"),
        normalize_gold(F.col(label), df.schema[label].dataType).alias("answer"),
        F.size("_ef_s").alias("n_sentences"),
    )


def format_code_tasks(df: DataFrame) -> DataFrame:
    """Raw code tasks -> common shape; missing fields read as ''."""
    def g(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(
        g("task_id").alias("task_id"),
        g("prompt").alias("input"),
        g("canonical_solution").alias("answer"),
        F.create_map(F.lit("task_id"), g("task_id"), F.lit("entry_point"), g("entry_point"),
                     F.lit("test"), g("test")).alias("additional_context"),
    )


def describe_tasks(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Add the signature line and the docstring block of each prompt."""
    return df.withColumn("signature", signature_line(F.col(prompt))).withColumn("docstring", docstring_block(F.col(prompt)))


def fewshot_requests(df: DataFrame, input_col: str = "input") -> DataFrame:
    """Request text asking a model for few-shot examples of one claim."""
    return df.withColumn("request", F.concat(F.lit(FEWSHOT_REQUEST_HEADER), F.lit("Original example:\n"),
                                             F.col(input_col), F.lit("\n\n"),
                                             F.lit(FEWSHOT_REQUEST_EXAMPLE), F.lit(FEWSHOT_REQUEST_FOOTER)))


def parse_fewshot(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Validate a few-shot reply, all or nothing.

    Valid: a JSON array whose every item has a string ``input`` and a string
    ``label`` that is SUPPORTED / NOT_SUPPORTED after strip + upper. Numbers as
    ``input`` are rejected. Adds ``valid``, ``items`` (array<struct<input,label>>,
    labels upper-cased; null when invalid), ``n_items`` and ``stored`` (the JSON
    kept in a few-shot file: the items, or ``{"raw": "ERROR: ..."}``).
    """
    v = F.try_parse_json(F.col(reply))
    arr = F.try_variant_get(v, "$", "array<variant>")

    def item_ok(x):
        inp = F.variant_get(x, "$.input", "variant")
        lab = F.variant_get(x, "$.label", "variant")
        lab_s = F.upper(py_strip(F.try_variant_get(x, "$.label", "string")))
        return ((F.schema_of_variant(inp) == "STRING") & (F.schema_of_variant(lab) == "STRING")
                & lab_s.isin(*LABELS))

    valid = F.coalesce(F.forall(arr, item_ok), F.lit(False))
    items = F.when(valid, F.transform(arr, lambda x: F.struct(
        F.try_variant_get(x, "$.input", "string").alias("input"),
        F.upper(py_strip(F.try_variant_get(x, "$.label", "string"))).alias("label"))))
    reason = (F.when(v.isNull(), F.lit("ERROR: Failed to parse model output as JSON"))
               .when(arr.isNull(), F.lit("ERROR: Expected a JSON array of examples"))
               .otherwise(F.lit("ERROR: Few-shot validation failed")))
    out = df.withColumn("valid", valid).withColumn("items", items)
    return (out.withColumn("n_items", F.when(F.col("valid"), F.size("items")))
               .withColumn("stored", F.when(F.col("valid"), F.to_json(F.col("items")))
                           .otherwise(F.to_json(F.struct(reason.alias("raw"))))))


def render_fewshot(items, raw, style: str, drop_errors: bool = True) -> Column:
    """Few-shot block text, or null when there is nothing to render."""
    items = col_of(items)
    if style == "claims":
        body = F.array_join(F.transform(items, lambda x, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(": "), py_str(x["input"]),
            F.lit("\nLabel: "), py_str(x["label"]))), "\n\n")
    elif style == "code":
        body = F.array_join(F.transform(items, lambda x, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), py_str(x["input"]),
            F.lit("\n\nSolution:\n"), py_str(x["solution"]))), "\n\n---\n\n")
    else:
        raise ValueError(f"unknown style {style!r}")
    has_items = F.coalesce(F.size(items), F.lit(0)) > 0
    raw = col_of(raw) if raw is not None else F.lit(None).cast("string")
    # a stored {"raw": "..."} wrapper renders its text
    raw = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.raw", "string"), raw)
    use_raw = F.coalesce(raw, F.lit("")) != ""
    if drop_errors:
        use_raw = use_raw & ~raw.startswith("ERROR:")
    return F.when(has_items, body).when(use_raw, raw)


def build_requests(df: DataFrame, style: str = "claims", input_col: str = "input", items: str = "items",
                   raw: str | None = None, system_prompt=None, drop_errors: bool = True) -> DataFrame:
    """Chat request per row: ``messages`` = [system, user] and the ``user_content`` text.

    Few-shots are rendered into the user message (claims or code style); a raw
    few-shot text is used verbatim; failed few-shots (``ERROR: ...``) are
    dropped unless ``drop_errors=False``; nothing to render -> plain input.
    """
    none = "array<struct<input:string,label:string>>" if style == "claims" else "array<struct<input:string,solution:string>>"
    few = render_fewshot(F.col(items) if items in df.columns else F.lit(None).cast(none),
                         F.col(raw) if raw and raw in df.columns else None, style, drop_errors)
    inp = F.col(input_col)
    if style == "claims":
        user = F.when(few.isNotNull(), F.concat(F.lit("Few-shot examples:\n"), few, F.lit("\n\nOriginal input:\n"), inp)).otherwise(inp)
    else:
        user = F.when(few.isNotNull(), F.concat(F.lit("Here are some examples:\n\n"), few,
                                                F.lit("\n\n---\n\nNow solve this:\n\n"), inp)).otherwise(inp)
    sys_col = system_prompt if isinstance(system_prompt, Column) else (
        F.col(system_prompt) if isinstance(system_prompt, str) and system_prompt in df.columns else F.lit(system_prompt or ""))
    out = df.withColumn("user_content", user).withColumn("system_content", sys_col)
    return out.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), F.col("system_content").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("user_content").alias("content"))))


def flatten_messages(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """One text per conversation: ``[role] content`` in turn order, blank-line joined.

    The unit is one chat request, bounded by the model's context window, so the
    per-conversation list is bounded; the collect is a partial aggregate.
    """
    msgs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), py_str(F.col(role)).alias("r"),
                                                py_str(F.col(text)).alias("t"))))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("["), m["r"], F.lit("] "), m["t"])), "\n\n").alias("flat_text"))
