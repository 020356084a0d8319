"""Derived fixture views over the driver tables.

The same SQL text defines a Spark view (built with ``spark.sql`` and DataFrame
arguments, no global temp views) and a DuckDB CTE for the oracle. They adapt the
generic driver tables to the evaluation domain: claims, candidates, responses,
generations, code tasks and replies, few-shot replies, event and metric logs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEW_SQL: dict[str, str] = {
    "v_claims": """
SELECT d.doc_id AS claim_id, d.text AS claim, d.text AS evidence,
       CASE d.doc_id % 10 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN ' supports ' WHEN 3 THEN 'Refutes' WHEN 4 THEN 'TRUE'
            WHEN 5 THEN 'entailment' WHEN 6 THEN 'not supported' WHEN 7 THEN 'maybe' WHEN 8 THEN NULL
            ELSE CAST(l.quality AS STRING) END AS label_raw
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_candidates": """
SELECT * FROM (VALUES (0, 'seed'), (1, 'optimized'), (2, 'fewshot_optimized'), (3, 'variant_b')) AS t(candidate_id, prompt_type)""",
    # every reply shape occurs (3 and 5 are coprime to 14); some replies quote the whole claim
    "v_replies": """
SELECT c.claim_id, k.candidate_id,
       CASE (c.claim_id * 3 + k.candidate_id * 5) % 14 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'NOT_SUPPORTED' WHEN 2 THEN 'not supported'
            WHEN 3 THEN 'Not-Supported.' WHEN 4 THEN concat('The claim is SUPPORTED', chr(10), c.claim) WHEN 5 THEN 'REFUTES' WHEN 6 THEN 'entailment'
            WHEN 7 THEN 'contradicted' WHEN 8 THEN concat('unsure', chr(10), c.claim) WHEN 9 THEN '' WHEN 10 THEN 'supports' WHEN 11 THEN 'UNSUPPORTED'
            WHEN 12 THEN 'NOT  SUPPORTED' ELSE 'not entailed' END AS response
FROM v_claims c CROSS JOIN v_candidates k""",
    # the replies that landed: one call in eleven is still missing
    "v_responses": """
SELECT claim_id, candidate_id, response FROM v_replies WHERE (claim_id + candidate_id) % 11 <> 10""",
    "v_generations": """
SELECT l_orderkey AS task_id, candidate_id,
       row_number() OVER (PARTITION BY candidate_id, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) AS sample_idx,
       l_returnflag = 'N' AS passed,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CASE (l_linenumber + l_suppkey) % 9 WHEN 0 THEN 'AssertionError' WHEN 1 THEN 'SyntaxError'
            WHEN 2 THEN 'MissingFunction' WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'ImportError' WHEN 5 THEN 'IndexError'
            WHEN 6 THEN NULL WHEN 7 THEN 'NameError' ELSE 'UnknownError' END END AS error_type
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS candidate_id FROM lineitem) l""",
    "v_code_tasks": """
SELECT p_partkey AS task_id, concat('f', CAST(p_partkey AS STRING)) AS entry_point,
       concat('from typing import List', chr(10), chr(10), 'def f', CAST(p_partkey AS STRING), '(x: int) -> int:', chr(10), '    ',
              CASE WHEN p_partkey % 3 = 0 THEN repeat(chr(39), 3) ELSE repeat(chr(34), 3) END, p_name, CASE WHEN p_partkey % 3 = 0 THEN repeat(chr(39), 3) WHEN p_partkey % 5 = 0 THEN '' ELSE repeat(chr(34), 3) END) AS prompt,
       CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('assert f', CAST(p_partkey AS STRING), '(1) == 1') END AS test
FROM part""",
    "v_code_replies": """
SELECT conv_id * 100 + turn AS reply_id, conv_id % 7 AS task_id, concat('f', CAST(conv_id % 7 AS STRING)) AS entry_point,
       CASE (conv_id + turn) % 5
            WHEN 0 THEN concat('Here: ', text, chr(10), concat(repeat('`', 3), 'python'), chr(10), 'def f', CAST(turn % 7 AS STRING), '(): pass', chr(10), repeat('`', 3), chr(10), 'done')
            WHEN 1 THEN concat(repeat('`', 3), chr(10), 'py', chr(10), 'def f1(): pass', chr(10), repeat('`', 3))
            WHEN 2 THEN concat(concat(repeat('`', 3), 'python'), chr(10), 'def f2(): pass # ', text)
            WHEN 3 THEN concat('  def f3(): pass # ', text, chr(10))
            ELSE concat(repeat('`', 3), chr(10), 'x = 1', chr(10), repeat('`', 3), chr(10), concat(repeat('`', 3), 'python'), chr(10), 'def f4(): pass', chr(10), repeat('`', 3)) END AS reply
FROM conversations WHERE role = 'assistant'""",
    "v_fewshot": """
SELECT doc_id AS id, text AS input,
       CASE doc_id % 6 WHEN 0 THEN '[{"input":"a","label":"supported"},{"input":"b","label":"NOT_SUPPORTED"}]' WHEN 1 THEN '[{"input":"a","label":"maybe"}]'
            WHEN 2 THEN '{"input":"a","label":"SUPPORTED"}' WHEN 3 THEN 'no json' WHEN 4 THEN '[{"input":1,"label":"SUPPORTED"}]' ELSE '[]' END AS reply
FROM documents""",
    # a few-shot table with gaps: some claims have no row
    "v_fewshot_gaps": """
SELECT * FROM v_fewshot WHERE id % 4 <> 3""",
    "v_event_log": """
SELECT event_id, ts, concat('run_', CAST(user_id % 20 AS STRING)) AS run_name,
       CASE event_type WHEN 'signup' THEN 'batch_start' WHEN 'view' THEN 'batch_complete' ELSE 'reflector_invocation' END AS event_type,
       CASE event_type WHEN 'click' THEN 'MissingFunction' WHEN 'error' THEN 'SyntaxError' WHEN 'purchase' THEN 'IndexError' END AS error_type,
       user_id AS task_id, CAST(floor(value) AS BIGINT) AS total_tokens
FROM events""",
    "v_metrics": """
SELECT event_type AS name, user_id AS step, value, ts, event_id FROM events""",
    "v_run_metrics": """
SELECT concat('run_2025', lpad(CAST(c_nationkey AS STRING), 4, '0')) AS run_id, substr(o_orderpriority, 1, 1) AS variant,
       sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS correct, count(*) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "v_reflections": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no structure'
       ELSE concat('MUTATION_ANALYSIS: cause ', event_type, chr(10), chr(10), 'SUGGESTED_PROMPT_CHANGE: name the function', chr(10), chr(10),
                   'PRIORITY_LEVEL: ', CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END) END AS reflector_output
FROM events""",
    # ---- views added here (not in the fixture list): execution details -------
    # execution results: replies of labelled conversations were executed (quality 1 passed,
    # toxic ones timed out); replies of other conversations have no result row
    "v_exec_results": """
SELECT c.conv_id * 100 + c.turn AS reply_id, l.quality = 1 AS passed,
       CASE WHEN l.quality = 1 THEN NULL WHEN l.toxic = 1 THEN 'TimeoutError' ELSE 'AssertionError' END AS error_type,
       CASE WHEN l.quality = 1 THEN NULL ELSE concat('run of reply ', CAST(c.conv_id AS STRING)) END AS error_message
FROM conversations c JOIN labels l ON c.conv_id = l.doc_id WHERE c.role = 'assistant'""",
    # execution details per generation: message, traceback, stdout, stderr
    "v_exec_details": """
SELECT task_id, candidate_id, sample_idx, passed, error_type,
       CASE WHEN passed THEN NULL ELSE concat(coalesce(error_type, 'Error'), ' in sample ', CAST(sample_idx AS STRING)) END AS error_message,
       CASE WHEN error_type IN ('AssertionError', 'IndexError', 'NameError')
            THEN repeat(concat('  line ', CAST(sample_idx AS STRING), chr(10)), 40 * sample_idx) END AS traceback,
       CASE sample_idx % 3 WHEN 0 THEN repeat('out ', 50 * sample_idx) WHEN 1 THEN '   ' END AS stdout,
       CASE WHEN error_type = 'ImportError' THEN 'ModuleNotFoundError: no module named x' END AS stderr
FROM v_generations""",
    # generated code per generation; tasks that the code task table lacks have no entry point or prompt
    "v_code_generations": """
SELECT g.task_id, g.candidate_id, g.sample_idx, g.passed, g.error_type, g.error_message, g.traceback,
       t.entry_point, t.prompt,
       concat('def ', coalesce(t.entry_point, 'g'), '(x):', chr(10), '    return ', repeat('x + ', 60 * g.sample_idx), '1') AS code
FROM v_exec_details g LEFT JOIN v_code_tasks t ON g.task_id = t.task_id""",
}

VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_replies": ("v_claims", "v_candidates"),
    "v_responses": ("v_replies", "v_claims", "v_candidates"),
    "v_fewshot_gaps": ("v_fewshot",),
    "v_exec_details": ("v_generations",),
    "v_code_generations": ("v_exec_details", "v_generations", "v_code_tasks"),
}

_REF = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)\b")


def views_needed(sql: str) -> list[str]:
    """Views referenced by a SQL text, dependencies first, in definition order."""
    found: set[str] = set()

    def visit(name: str) -> None:
        if name in found:
            return
        for dep in VIEW_DEPS.get(name, ()):
            visit(dep)
        found.add(name)

    for name in VIEW_SQL:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return [v for v in VIEW_SQL if v in found]


def with_views(body: str) -> str:
    """Prefix a DuckDB query body with the CTEs of the views it uses."""
    needed = views_needed(body)
    body = body.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Fixture:
    """Driver tables of one scale-factor folder plus the derived views, as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # overrides replace base tables (e.g. a stream over the same file)
        self._cache: dict[str, DataFrame] = dict(overrides or {})

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        if name == "v_replies":
            df = replies_for(self.table("documents"), self.view("v_candidates"))
        else:
            text = VIEW_SQL[name].replace("{", "{{").replace("}", "}}")
            refs = {}

            def sub(m):
                ref = m.group(2)
                if ref in BASE_TABLES:
                    refs[ref] = self.table(ref)
                elif ref in VIEW_SQL:
                    refs[ref] = self.view(ref)
                else:
                    return m.group(0)
                return f"{m.group(1)} {{{ref}}}"

            text = _REF.sub(sub, text)
            df = self.spark.sql(text, **refs)
            if name == "v_generations":
                # Spark's row_number is INT, the SQL standard's (and DuckDB's) BIGINT
                df = df.withColumn("sample_idx", df["sample_idx"].cast("long"))
        self._cache[name] = df
        return df


# Replies of the fixture reply table, picked by (claim_id * 3 + candidate_id * 5) % 14; ``QUOTING`` ones
# go on with the whole claim text.
FIXTURE_REPLIES = ("SUPPORTED", "NOT_SUPPORTED", "not supported", "Not-Supported.", "The claim is SUPPORTED",
                   "REFUTES", "entailment", "contradicted", "unsure", "", "supports", "UNSUPPORTED",
                   "NOT  SUPPORTED", "not entailed")
QUOTING = (4, 8)


def reply_index(claim_id, candidate_id):
    return (claim_id * 3 + candidate_id * 5) % 14


def landed(df: DataFrame) -> DataFrame:
    """The rows of a reply table whose call has landed (``v_responses``)."""
    from pyspark.sql import functions as F
    return df.filter((F.col("claim_id") + F.col("candidate_id")) % 11 != 10)


def replies_for(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """v_replies in Spark: the evaluation grid (no cross join) plus the reply table; works on streams too."""
    from pyspark.sql import functions as F

    from evalframe.operators.joins import evaluation_grid

    grid = evaluation_grid(documents.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("claim")), candidates)
    idx = reply_index(F.col("claim_id"), F.col("candidate_id"))
    reply = F.element_at(F.array(*[F.lit(r) for r in FIXTURE_REPLIES]), (idx + 1).cast("int"))
    quoted = F.when(idx.isin(*QUOTING), F.concat(reply, F.lit("\n"), F.col("claim"))).otherwise(reply)
    return grid.select("claim_id", "candidate_id", quoted.alias("response"))
