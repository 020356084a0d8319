"""Bitmaps of wins, dominance, seeded draws, guidance rules as rows, committed batches, files written one per row: against plain versions."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalframe.operators import candidates, feedback
from evalframe.sources import files
from evalframe.streaming import live


def scored_rows(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        e = k * 331 - 4000  # whole numbers of several bitmap blocks, below zero too
        for c in range(7):
            p = {0: 0.2, 1: 0.5, 2: 0.5, 3: 0.0}.get(c, 0.3)
            rows.append((e, c, None if c == 6 else float(rng.random() < p)))
        if k % 2:
            rows[-3] = (e, 4, rows[-6][2])  # 4 scores as 1 does on odd examples, and 0 on even ones
        else:
            rows[-3] = (e, 4, 0.0)
    return rows


def plain(rows):
    best, wins = {}, {}
    for e, _, s in rows:
        if s is not None:
            best[e] = max(s, best.get(e, s))
    for e, c, s in rows:
        if s is not None and s == best[e]:
            wins.setdefault(c, set()).add(e)
    mean = {c: sum(s for _, d, s in rows if d == c and s is not None) / max(1, sum(d == c for _, d, _ in rows)) for c in wins}
    ahead = lambda a, b: len(wins[a]) > len(wins[b]) or mean[a] > mean[b] or (mean[a] == mean[b] and a < b)
    return wins, {b for b in wins if not any(a != b and wins[b] <= wins[a] and ahead(a, b) for a in wins)}


def test_bitmaps_equal_the_frontier(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, "claim_id long, candidate_id int, score double").repartition(5)
    wins, alive = plain(rows)
    cands = spark.createDataFrame([(i,) for i in range(9)], "candidate_id int")
    got = {r.candidate_id: r.n_wins for r in candidates.coverage_of(candidates.win_bitmaps(df), cands).collect()}
    assert got == {c: len(wins.get(c, ())) for c in range(9)}
    want = candidates.frontier_coverage(candidates.instance_frontier(df), cands)
    assert got == {r.candidate_id: r.n_wins for r in want.collect()}
    means = df.groupBy("candidate_id").agg((F.sum("score") / F.count("*")).alias("val_score"))
    front = candidates.undominated(candidates.win_bitmaps(df), means)
    assert {r.candidate_id for r in front.collect()} == alive


def test_equal_wins_keep_one(spark):
    rows = [(e, c, 1.0) for e in range(40_000, 40_010) for c in (5, 2, 9)]
    df = spark.createDataFrame(rows, "claim_id long, candidate_id int, score double")
    scores = spark.createDataFrame([(5, 0.5), (2, 0.5), (9, 0.4)], "candidate_id int, val_score double")
    assert [tuple(r) for r in candidates.undominated(candidates.win_bitmaps(df), scores).collect()] == [(2, 10, 0.5)]


def test_draws_follow_the_weights(spark):
    front = spark.createDataFrame([(0, 1), (1, 3), (2, 6), (3, 0)], "candidate_id int, n_wins long")
    rounds = front.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    got = candidates.select_parents(rounds, 2, by=["iteration"], round_=F.col("iteration")).collect()
    assert len(got) == 6000
    first = Counter(r.candidate_id for r in got if r.draw == 1)
    assert first[3] == 0 and abs(first[2] / 3000 - 0.6) < 0.04 and abs(first[1] / 3000 - 0.3) < 0.04
    pairs = Counter(tuple(r.candidate_id for r in got if r.iteration == i) for i in range(1, 50))
    assert all(len(set(p)) == 2 for p in pairs)
    again = candidates.select_parents(rounds.repartition(7), 2, by=["iteration"], round_=F.col("iteration")).collect()
    assert sorted(got) == sorted(again)
    assert candidates.select_parents(front, 5).count() == 3  # fewer than asked for


def plain_guidance(rules, status, error):
    s, e = (status or "").lower(), (error or "").lower()
    hit = sorted((p, k, g) for p, k, g in rules if k is not None and (k.lower() in s or k.lower() in e))
    return hit[0][1:] if hit else ("default", feedback.DEFAULT_GUIDANCE)


def test_rule_table_equals_first_match(spark):
    rng = random.Random(4)
    rules = [(rng.randrange(50), "".join(rng.choice("abCé_") for _ in range(rng.randrange(1, 6))), f"g{i}") for i in range(300)] + [(3, None, "no rule")]
    rows = [(i, rng.choice([None, "", "syntax_error", "abcaé", "CCa"]), rng.choice([None, "", "AB_é", "x" * 50, "TimeoutError", "caé_Ca"])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, status string, error_type string")
    table = spark.createDataFrame(rules, "priority int, rule string, guidance string")
    got = {r.i: (r.guidance_key, r.guidance) for r in feedback.attach_guidance_table(df, table).collect()}
    assert got == {i: plain_guidance(rules, s, e) for i, s, e in rows}
    fixed = feedback.attach_guidance_table(df, feedback.guidance_rules(spark)).select("i", "guidance_key", "guidance")
    assert sorted(fixed.collect()) == sorted(feedback.attach_guidance(df).select("i", "guidance_key", "guidance").collect())
    assert {r.guidance_key for r in feedback.attach_guidance_table(df, table.limit(0)).collect()} == {"default"}
    every = feedback.attach_guidance_table(df, spark.createDataFrame([(1, "", "all")], "priority int, rule string, guidance string"))
    assert {r.guidance for r in every.collect()} == {"all"}


def test_ten_thousand_rules(spark):
    table = spark.range(10_000).selectExpr("cast(id as int) as priority", "concat('Err', id, 'x') as rule", "concat('g', id) as guidance")
    df = spark.range(2000).selectExpr("id", "'failed' as status", "concat('an Err', id * 5, 'X here') as error_type")
    got = feedback.attach_guidance_table(df, table)
    assert got.filter(F.col("guidance") == F.concat(F.lit("g"), F.col("id") * 5)).count() == 2000


def test_a_replayed_batch_takes_its_own_place(spark, tmp):
    schema = "k long"
    put = lambda name, *ks: live.commit(spark.createDataFrame([(k,) for k in ks], schema), tmp, name)
    see = lambda: sorted(r.k for r in live.read_committed(spark, tmp, schema).collect())
    assert see() == []
    put("batch-0", 1, 2)
    put("batch-1", 3)
    before = live.read_committed(spark, tmp, schema)
    spark.createDataFrame([(99,)], schema).write.parquet(f"{tmp}/data/batch-0-half")  # a batch that died before its manifest
    assert see() == [1, 2, 3]
    put("batch-0", 1, 2)
    assert see() == [1, 2, 3]
    assert sorted(r.k for r in before.collect()) == [1, 2, 3]  # a reader that began earlier
    put("batch-0")
    assert see() == [3]


def test_files_one_per_row(spark, tmp):
    df = spark.createDataFrame([("a/x_prompt.txt", "one\ntwo\n\nthree "), ("b/c/y.txt", None)], "path string, text string")
    assert files.write_files(df, tmp) == 2
    assert open(f"{tmp}/a/x_prompt.txt").read() == "one\ntwo\n\nthree " and open(f"{tmp}/b/c/y.txt").read() == ""
    assert not [f for f in os.listdir(f"{tmp}/a") if f.startswith(".x")]


def test_prompts_of_several_lines(spark, tmp):
    files.write_files(spark.createDataFrame([("r1/seed_prompt.txt", " first\nsecond\n"), ("r1/optimized_prompt.txt", "zz\naa\n\nbb ")], "path string, text string"), tmp)
    r = files.read_prompts(spark, f"{tmp}/*/*_prompt.txt").first()
    assert (r.seed_prompt, r.optimized_prompt) == ("first\nsecond", "zz\naa\n\nbb")
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([("r2/optimized_prompt.txt/x", "")], "path string, text string"), f"{tmp}/r1/seed_prompt.txt")
