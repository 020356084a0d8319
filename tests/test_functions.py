"""Golden rows for the column functions (own rows, hand-derived from the source semantics)."""

from pyspark.sql import functions as F

from evalframe.functions.code import (docstring_block, extract_code,
                                      guidance_key, missing_function,
                                      signature_line, status_of)
from evalframe.functions.text import pct_string, preview, py_strip
from evalframe.functions.verdicts import normalize_gold, parse_verdict
from evalframe.operators.shaping import number_sentences, split_evidence

P, N = "SUPPORTED", "NOT_SUPPORTED"


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_verdict_traps(spark):
    cases = {
        "supported": P, "not supported": N, "Not-Supported.": N, "NOT  SUPPORTED": P, "not\nsupported": P,
        "UNSUPPORTED": P, "support": N, "supports": P, "not supports": P, "refuted": N, "contradiction": N,
        "entailed": P, "not entailed": P, "NotSupport": N, "": N, "SUPPORTED, though parts contradict": N,
    }
    got = one_col(spark, list(cases), parse_verdict)
    assert got == list(cases.values())
    assert one_col(spark, [None], parse_verdict) == [N]


def test_gold_labels_strings(spark):
    cases = {"0": P, " 0 ": P, "00": P, "1": N, "7": N, "-1": N, "supports": P, "True": P, "not supported": N,
             "entailment": P, "maybe": N, None: N, "\t0\n": P}
    assert one_col(spark, list(cases), normalize_gold) == list(cases.values())


def test_gold_labels_numbers(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (None,), (-0.5,)], "v double")
    got = [r[0] for r in df.select(normalize_gold(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [P, N, N, P]
    b = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert [r[0] for r in b.select(normalize_gold(F.col("v"), b.schema["v"].dataType)).collect()] == [N, P]


def test_py_strip_matches_python(spark):
    vals = ["\n a \t", " x　", "  ", "", "a b"]
    assert one_col(spark, vals, py_strip) == [v.strip() for v in vals]


def test_evidence_split(spark):
    got = one_col(spark, ["Pi is 3.14. Yes. ", None, "..."], lambda c: number_sentences(split_evidence(c)))
    assert got == ["1. Pi is 3\n2. 14\n3. Yes", "", ""]


def test_extract_code(spark):
    fence, pyf = "```", "```python"
    cases = [
        (f"Here:\n{pyf}\ndef f(): pass\n{fence}\ndone", "def f(): pass"),
        (f"{fence}\npy\ndef g(): pass\n{fence}", "def g(): pass"),
        (f"{pyf}\ndef h(): pass", f"{pyf}\ndef h(): pass"),
        ("  def k(): pass\n", "def k(): pass"),
        (f"{fence}\nx = 1\n{fence}\n{pyf}\ndef m(): pass\n{fence}", "def m(): pass"),
        (f"{fence}python{fence}", ""),
        (f"{fence}\n\nbody\n{fence}", "body"),
        (None, ""),
    ]
    assert one_col(spark, [c[0] for c in cases], extract_code) == [c[1] for c in cases]


def test_signature_and_docstring(spark):
    p1 = 'from x import y\n\n  def f(a):\n    """Doc."""\n'
    p2 = "def g():\n    '''single'''"
    p3 = 'def h():\n    """open only'
    p4 = 'def q():\n    """a\'\'\'b\'\'\'"""'
    sig = one_col(spark, [p1, p2, p3, "no def"], signature_line)
    assert sig == ["def f(a):", "def g():", "def h():", ""]
    doc = one_col(spark, [p1, p2, p3, p4], docstring_block)
    assert doc == ['"""Doc."""', "'''single'''", "", '"""a\'\'\'b\'\'\'"""']


def test_missing_function_is_substring(spark):
    df = spark.createDataFrame([("# calls f1 later", "f1"), ("def g(): pass", "f1"), ("x", "")], "c string, e string")
    assert [r[0] for r in df.select(missing_function("c", "e")).collect()] == [False, True, False]


def test_status_and_guidance(spark):
    rows = [(True, None), (False, "AssertionError"), (False, "SyntaxError"), (False, "TimeoutError"),
            (False, "ImportError"), (False, "UnboundLocalError"), (False, "MissingFunction"), (False, None)]
    df = spark.createDataFrame(rows, "p boolean, e string")
    st = [r[0] for r in df.select(status_of("p", "e")).collect()]
    assert st == ["passed", "failed", "syntax_error", "timeout", "import_error", "runtime_error", "failed", "runtime_error"]
    g = spark.createDataFrame([("syntax_error", "SyntaxError"), ("failed", "SyntaxError"), ("timeout", "TimeoutError"),
                               ("runtime_error", "UnboundLocalError"), ("failed", "AssertionError"), ("failed", None)],
                              "s string, e string")
    keys = [r[0] for r in g.select(guidance_key("s", "e")).collect()]
    assert keys == ["syntax_error", "default", "timeout", "default", "AssertionError", "default"]


def test_preview_and_pct(spark):
    assert one_col(spark, ["abcdef", "abc"], lambda c: preview(c, 3)) == ["abc...", "abc"]
    df = spark.createDataFrame([(314, 500), (1, 8), (0, 0), (-13, 500), (97, 800)], "a long, b long")
    got = [r[0] for r in df.select(pct_string("a", "b")).collect()]
    assert got == ["62.80%", "12.50%", "0.00%", "-2.60%", "12.13%"]


def test_cluster_settings_scale():
    from evalframe.session import cluster_settings
    s = cluster_settings(100 * 1024 ** 4, executor_cores=1000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert int(s["spark.sql.execution.arrow.maxRecordsPerBatch"]) == 8192
    assert int(cluster_settings(10 ** 6, executor_cores=8)["spark.sql.shuffle.partitions"]) == 24


def test_fixed_texts_are_what_results_must_hold(spark):
    """Golden literals, written out here so that a slip in the shared constants does not pass on both sides."""
    from evalframe.functions.code import guidance, guidance_key
    from evalframe.functions.verdicts import normalize_gold, parse_verdict
    rows = [("failed", "AssertionError"), ("timeout", "TimeoutError"), ("failed", "missingfunction"), ("runtime_error", None), ("syntax_error", "KeyError")]
    d = spark.createDataFrame(rows, "s string, e string").select(guidance_key("s", "e").alias("k"), guidance("s", "e").alias("g")).collect()
    assert [r.k for r in d] == ["AssertionError", "timeout", "MissingFunction", "default", "syntax_error"]
    assert d[0].g.split("\n") == ["- The code ran but produced wrong output for test cases", "- The logic is incorrect - review the algorithm",
                                  "- Edge cases may not be handled properly"]
    assert d[3].g.startswith("- Review the error message and traceback for specific issues")
    replies = {"SUPPORTED": "SUPPORTED", "NOT_SUPPORTED": "NOT_SUPPORTED", "not supported": "NOT_SUPPORTED", "Not-Supported.": "NOT_SUPPORTED", "The claim is SUPPORTED": "SUPPORTED",
               "REFUTES": "NOT_SUPPORTED", "entailment": "SUPPORTED", "contradicted": "NOT_SUPPORTED", "unsure": "NOT_SUPPORTED", "": "NOT_SUPPORTED", "supports": "SUPPORTED",
               "UNSUPPORTED": "SUPPORTED", "NOT  SUPPORTED": "SUPPORTED", "not entailed": "SUPPORTED"}
    got = spark.createDataFrame([(r,) for r in replies], "r string").select("r", parse_verdict("r").alias("v")).collect()
    assert {r.r: r.v for r in got} == replies
    golds = {"0": "SUPPORTED", "00": "SUPPORTED", "1": "NOT_SUPPORTED", " supports ": "SUPPORTED", "Refutes": "NOT_SUPPORTED", "TRUE": "SUPPORTED",
             "entailment": "SUPPORTED", "not supported": "NOT_SUPPORTED", "maybe": "NOT_SUPPORTED"}
    got = spark.createDataFrame([(r,) for r in golds], "r string").select("r", normalize_gold("r").alias("v")).collect()
    assert {r.r: r.v for r in got} == golds
