"""Property tests: column functions against small Python models of the stated rules, on random text,
plus N-note checks that need several operators."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.functions.constants import (GOLD_POSITIVE, NEGATIVE, POSITIVE,
                                           VERDICT_NEGATIVE_CUES,
                                           VERDICT_POSITIVE_CUES)
from evalframe.functions.text import py_strip
from evalframe.functions.verdicts import normalize_gold, parse_verdict
from evalframe.operators import metrics, shaping, splits

WORDS = ["not", "supported", "support", "supports", "refute", "refuted", "entail", "contradict", "NOT_SUPPORTED",
         "Not-Supported", "unsupported", " ", "  ", "-", "\n", "\t", "x", "0", "7", "true", "TRUE", "entailment", "ẞ", "　"]
text = st.lists(st.sampled_from(WORDS), max_size=6).map("".join)


def verdict_model(s):
    norm = (s or "").upper().replace(" ", "_").replace("-", "_")
    if any(c in norm for c in VERDICT_NEGATIVE_CUES):
        return NEGATIVE
    return POSITIVE if any(c in norm for c in VERDICT_POSITIVE_CUES) else NEGATIVE


def gold_model(s):
    if s is None:
        return NEGATIVE
    t = s.strip()
    if t and all(ch in string.digits for ch in t):
        return POSITIVE if int(t) == 0 else NEGATIVE
    return POSITIVE if t.upper().replace(" ", "_") in GOLD_POSITIVE else NEGATIVE


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(text, min_size=20, max_size=60))
def test_verdict_property(spark, values):
    ascii_vals = [v.replace("ẞ", "") for v in values]  # upper-casing of non-ASCII differs between engines
    assert _apply(spark, ascii_vals, parse_verdict) == [verdict_model(v) for v in ascii_vals]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), text, st.sampled_from(["0", " 00 ", "12", "-1", "supports", " true "])),
                min_size=20, max_size=60))
def test_gold_property(spark, values):
    assert _apply(spark, values, normalize_gold) == [gold_model(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x85\xa0 　ab.", max_size=12), min_size=20, max_size=60))
def test_strip_property(spark, values):
    assert _apply(spark, values, py_strip) == [v.strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" .ab\n3", max_size=20), min_size=10, max_size=40))
def test_evidence_property(spark, values):
    def model(e):
        parts = [p.strip() for p in e.split(".") if p.strip()]
        return "\n".join(f"{i + 1}. {p}" for i, p in enumerate(parts))
    got = _apply(spark, values, lambda c: shaping.number_sentences(shaping.split_evidence(c)))
    assert got == [model(v) for v in values]


def test_remaining_after_full_run_is_empty(spark):
    ex = spark.range(0, 50).withColumnRenamed("id", "claim_id")
    assert splits.remaining(ex, ex, ["claim_id"]).count() == 0


def test_null_error_bucket_and_sum(spark):
    rows = [(1, 0, 1, False, None), (2, 0, 1, False, None), (3, 0, 1, False, "IndexError"), (4, 0, 1, True, None)]
    g = spark.createDataFrame(rows, "task_id long, candidate_id int, sample_idx long, passed boolean, error_type string")
    d = {r.error_type: r.n for r in metrics.error_distribution(g).collect()}
    assert d == {None: 2, "IndexError": 1}
    p = metrics.pass_at_1(g).collect()[0]
    assert p.passed + sum(d.values()) == p.total


def test_failed_fewshot_dropped_by_default(spark):
    df = spark.createDataFrame([(1, "in", None, '{"raw": "ERROR: bad"}'), (2, "in", None, "free text")],
                               "id int, input string, items array<struct<input:string,label:string>>, raw string")
    a = {r.id: r.user_content for r in shaping.build_requests(df, items="items", raw="raw").collect()}
    assert a[1] == "in" and a[2].startswith("Few-shot examples:\nfree text")
    b = {r.id: r.user_content for r in shaping.build_requests(df, items="items", raw="raw", drop_errors=False).collect()}
    assert "ERROR: bad" in b[1]


def test_sample_report_cuts_code(spark):
    g = spark.createDataFrame([(1, 0, 1, True, None, "x" * 500)],
                              "task_id long, candidate_id int, sample_idx long, passed boolean, error_type string, code string")
    r = metrics.sample_report(g, 5, code="code").collect()[0]
    assert len(r.sample_list[0]["c"]) == 200


def test_hot_key_aggregates_match_brute_force(spark):
    from evalframe.operators import joins
    # one task holds a third of all generations; one few-shot text a third of the few-shot rows
    rows = [(0 if i % 3 == 0 else i, 0, (i // 3) + 1 if i % 3 == 0 else 1, i % 7 == 0) for i in range(3000)]
    g = spark.createDataFrame(rows, "task_id long, candidate_id int, sample_idx long, passed boolean").repartition(9)
    r = metrics.pass_at_k(g, ks=(1, 3, 5)).collect()[0]
    tasks = {}
    for t, _, s, p in rows:
        tasks.setdefault(t, []).append((s, p))
    want = {k: sum(any(p and s <= k for s, p in v) for v in tasks.values()) for k in (1, 3, 5)}
    assert (r.solved_at_1, r.solved_at_3, r.solved_at_5) == (want[1], want[3], want[5]) and r.n_tasks == len(tasks)
    fs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}", f"v{i}") for i in range(3000)],
                               "id long, input string, few_shot string").repartition(9)
    ex = spark.createDataFrame([(1, "hot"), (2, "t1"), (3, "none")], "claim_id long, input string")
    a = {x.claim_id: x.few_shot for x in joins.attach_fewshot(ex, fs).collect()}
    assert a == {1: "v2997", 2: "v1", 3: None}
