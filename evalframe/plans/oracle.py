"""DuckDB oracle SQL per registered query (views inlined as CTEs by ``with_views``)."""

from __future__ import annotations

from evalframe.functions.constants import (CLAIMS_FEEDBACK_NOTES,
                                           CODE_PASS_NOTES, DEFAULT_GUIDANCE,
                                           ERROR_GUIDANCE,
                                           FEWSHOT_REQUEST_EXAMPLE,
                                           FEWSHOT_REQUEST_FOOTER,
                                           FEWSHOT_REQUEST_HEADER,
                                           REFLECTION_FOOTER, REFLECTION_HEADER)
from evalframe.plans import sqlfrag as S
from evalframe.plans.views import with_views

NL = "chr(10)"
SYSTEM_PROMPT = "Decide whether the context supports the claim. Answer SUPPORTED or NOT_SUPPORTED."

CLAIMS = f"""v_fmt AS (
  SELECT claim_id, {S.claim_input('claim', 'evidence')} AS input, {S.gold('label_raw')} AS answer,
         CAST(len({S.sentences('evidence')}) AS INTEGER) AS n_sentences, evidence
  FROM v_claims)"""

SCORED = f"""v_scored AS (
  SELECT r.claim_id, r.candidate_id, r.response, {S.verdict('r.response')} AS predicted_label, f.answer
  FROM v_responses r LEFT JOIN v_fmt f ON r.claim_id = f.claim_id
), v_sc AS (
  SELECT *, {S.label_match('predicted_label', 'answer')} AS correct,
         CASE WHEN {S.label_match('predicted_label', 'answer')} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score
  FROM v_scored)"""

TRAIN = """v_rank AS (
  SELECT claim_id, row_number() OVER (ORDER BY md5('42|' || CAST(claim_id AS VARCHAR)), claim_id) AS rank FROM v_claims
), v_train AS (
  SELECT claim_id FROM v_rank WHERE rank <= (SELECT CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM v_claims))"""

STATUS = """(CASE WHEN coalesce(passed, false) THEN 'passed' WHEN error_type = 'SyntaxError' THEN 'syntax_error'
  WHEN error_type = 'ImportError' THEN 'import_error' WHEN error_type = 'TimeoutError' THEN 'timeout'
  WHEN error_type = 'LLMError' THEN 'llm_error'
  WHEN error_type IN ('AssertionError', 'MissingFunction', 'NoTestCode') THEN 'failed' ELSE 'runtime_error' END)"""

CAND_SCORES = """v_cs AS (
  SELECT candidate_id, count(*) AS n, sum(score) AS score_sum, sum(score) / count(*) AS val_score FROM v_sc GROUP BY candidate_id)"""

FRONTIER = """v_fr AS (
  SELECT claim_id, max(score) AS best_score,
         list_sort(list_distinct(list(candidate_id) FILTER (WHERE score = best_s))) AS fl
  FROM (SELECT *, max(score) OVER (PARTITION BY claim_id) AS best_s FROM v_sc) GROUP BY claim_id)"""

COMPARE = """v_cmp AS (
  SELECT m.run_id, m.variant, CAST(m.correct AS BIGINT) AS correct, m.total,
         CASE WHEN m.total > 0 THEN CAST(m.correct AS BIGINT) / m.total ELSE CAST(0.0 AS DOUBLE) END AS accuracy,
         b.accuracy AS baseline_accuracy, b.correct AS baseline_correct, b.total AS baseline_total
  FROM v_run_metrics m LEFT JOIN (
    SELECT run_id, CASE WHEN total > 0 THEN CAST(correct AS BIGINT) / total ELSE CAST(0.0 AS DOUBLE) END AS accuracy,
           CAST(correct AS BIGINT) AS correct, total FROM v_run_metrics WHERE variant = '1') b ON m.run_id = b.run_id
), v_cmp2 AS (
  SELECT *, accuracy - baseline_accuracy AS delta_absolute,
         CASE WHEN baseline_accuracy <> 0 THEN (accuracy - baseline_accuracy) / baseline_accuracy * 100 ELSE NULL END AS delta_percent,
         correct - baseline_correct AS additional_correct
  FROM v_cmp)"""


def guidance_sql(status: str, err: str, pick_key: bool) -> str:
    s, e = f"lower(coalesce({status}, ''))", f"lower(coalesce({err}, ''))"
    whens = " ".join(f"WHEN contains({s}, {S.lit(k.lower())}) OR contains({e}, {S.lit(k.lower())}) "
                     f"THEN {S.lit(k if pick_key else t)}" for k, t in ERROR_GUIDANCE)
    return f"(CASE {whens} ELSE {S.lit('default' if pick_key else DEFAULT_GUIDANCE)} END)"


def extract_cte(src: str, keys: str, reply: str = "reply", name: str = "v_code") -> str:
    """Fence extraction over ``src`` (same steps as the Spark expression); keeps ``keys``."""
    return f"""{name}_0 AS (
  SELECT {keys}, {S.strip(f"coalesce({reply}, '')")} AS r FROM {src}
), {name}_1 AS (
  SELECT *, instr(r, '```python') AS p, instr(r, '```') AS q FROM {name}_0
), {name}_2 AS (
  SELECT *, CASE WHEN p > 0 AND instr(substr(r, p + 9), '```') > 0 THEN p + 9 + instr(substr(r, p + 9), '```') - 1 ELSE 0 END AS p_end,
         CASE WHEN q > 0 AND instr(substr(r, q + 3), '```') > 0 THEN q + 3 + instr(substr(r, q + 3), '```') - 1 ELSE 0 END AS q_end
  FROM {name}_1
), {name}_3 AS (
  SELECT *, {S.strip("substr(r, q + 3, q_end - (q + 3))")} AS body FROM {name}_2
), {name}_4 AS (
  SELECT *, CASE WHEN instr(body, chr(10)) > 0 THEN substr(body, 1, instr(body, chr(10)) - 1) ELSE body END AS first_line,
         CASE WHEN instr(body, chr(10)) > 0 THEN substr(body, instr(body, chr(10)) + 1) ELSE '' END AS rest
  FROM {name}_3
), {name} AS (
  SELECT {keys},
         CASE WHEN p > 0 AND p_end > 0 THEN {S.strip("substr(r, p + 9, p_end - (p + 9))")}
              WHEN q > 0 AND q_end > 0 THEN {S.strip(f"CASE WHEN {S.strip('first_line')} IN ('python', 'py', '') THEN rest ELSE body END")}
              ELSE r END AS code
  FROM {name}_4)"""


EXTRACT = extract_cte("v_code_replies", "reply_id, task_id, entry_point")

EXEC = f"""v_st AS (SELECT *, {STATUS} AS status FROM v_exec_details)"""

FAILURES = """v_fail AS (
  SELECT row_number() OVER (ORDER BY task_id, candidate_id, sample_idx) AS failure_idx, task_id, candidate_id, sample_idx,
         'unknown' AS entry_point, error_type, error_message, traceback,
         'Failed on problem ' || CAST(task_id AS VARCHAR) AS guidance
  FROM v_exec_details WHERE coalesce(passed = false, false))"""

REFL = f"""v_pr AS (
  SELECT event_id, reflector_output AS o0, coalesce(reflector_output, '') AS o FROM v_reflections
), v_pr2 AS (
  SELECT event_id, contains(o, 'SUGGESTED_PROMPT_CHANGE:') AS has_change,
         {S.strip("string_split(o, 'SUGGESTED_PROMPT_CHANGE:')[-1]")} AS after, o
  FROM v_pr
), v_pr3 AS (
  SELECT event_id, has_change,
         CASE WHEN has_change THEN after ELSE 'See log' END AS change_raw,
         CASE WHEN has_change THEN {S.strip("string_split(after, 'PRIORITY_LEVEL:')[1]")} ELSE 'See log' END AS change,
         CASE WHEN contains(o, 'MUTATION_ANALYSIS:') THEN {S.strip("regexp_extract(o, 'MUTATION_ANALYSIS:([^\\n]*)', 1)")} END AS analysis,
         nullif(regexp_extract(o, 'PRIORITY_LEVEL:[ \\t]*(HIGH|MEDIUM|LOW)', 1), '') AS priority
  FROM v_pr2)"""


def _fewshot_valid(reply: str) -> str:
    """Columns j (json or 'null'), arr (list of json items), valid."""
    return f"""SELECT *, coalesce(json_type(j) = 'ARRAY' AND
              len(list_filter(json_extract(j, '$[*]'), lambda x: NOT coalesce(
                json_type(x, '$.input') = 'VARCHAR' AND json_type(x, '$.label') = 'VARCHAR' AND
                upper({S.strip("json_extract_string(x, '$.label')")}) IN ('SUPPORTED', 'NOT_SUPPORTED'), false))) = 0,
              false) AS valid
       FROM (SELECT *, CASE WHEN {reply} IS NOT NULL AND json_valid({reply}) THEN {reply} ELSE 'null' END AS j FROM src)"""


ORACLE_BODY: dict[str, str] = {}

# ---------------------------------------------------------------- B
ORACLE_BODY["claims_format"] = f"WITH {CLAIMS} SELECT claim_id, input, answer, n_sentences FROM v_fmt"
ORACLE_BODY["gold_labels"] = f"SELECT claim_id, label_raw, {S.gold('label_raw')} AS answer FROM v_claims"
ORACLE_BODY["code_tasks_format"] = """
SELECT CAST(task_id AS VARCHAR) AS task_id, coalesce(prompt, '') AS input, '' AS answer, CAST(task_id AS VARCHAR) AS ctx_task_id,
       coalesce(entry_point, '') AS ctx_entry_point, coalesce(test, '') AS ctx_test FROM v_code_tasks"""
_DOC = lambda m: (f"CASE WHEN instr(prompt, {S.lit(m)}) > 0 AND instr(substr(prompt, instr(prompt, {S.lit(m)}) + 3), {S.lit(m)}) > 0 "
                  f"THEN substr(prompt, instr(prompt, {S.lit(m)}), instr(substr(prompt, instr(prompt, {S.lit(m)}) + 3), {S.lit(m)}) + 5) END")
ORACLE_BODY["task_signatures"] = f"""
SELECT task_id,
       coalesce({S.strip(f"list_filter(string_split({S.strip("coalesce(prompt, '')")}, chr(10)), lambda l: starts_with({S.strip('l')}, 'def '))[1]")}, '') AS signature,
       coalesce({_DOC('"""')}, {_DOC("'''")}, '') AS docstring
FROM v_code_tasks"""
ORACLE_BODY["fewshot_requests"] = f"""WITH {CLAIMS}
SELECT claim_id, {S.lit(FEWSHOT_REQUEST_HEADER)} || 'Original example:' || {NL} || input || {NL} || {NL} ||
       {S.lit(FEWSHOT_REQUEST_EXAMPLE)} || {S.lit(FEWSHOT_REQUEST_FOOTER)} AS request FROM v_fmt"""
ORACLE_BODY["fewshot_validate"] = f"""WITH src AS (SELECT * FROM v_fewshot), v AS ({_fewshot_valid('reply')})
SELECT id, valid, CASE WHEN valid THEN CAST(json_array_length(j) AS INTEGER) END AS n_items,
       CASE WHEN valid THEN array_to_string(list_transform(json_extract(j, '$[*]'),
            lambda x: upper({S.strip("json_extract_string(x, '$.label')")})), ',') END AS labels
FROM v"""
ORACLE_BODY["requests_claims"] = f"""WITH {CLAIMS},
last AS (SELECT input AS k, arg_max(reply, id) AS few_shot FROM v_fewshot_gaps GROUP BY input),
src AS (SELECT f.claim_id, f.input, l.few_shot FROM v_fmt f LEFT JOIN last l ON f.evidence = l.k),
v AS ({_fewshot_valid('few_shot')}),
r AS (SELECT claim_id, input, CASE WHEN valid AND json_array_length(j) > 0 THEN array_to_string(list_transform(json_extract(j, '$[*]'),
        lambda x, i: 'Example ' || CAST(i AS VARCHAR) || ': ' || json_extract_string(x, '$.input') || {NL} || 'Label: ' ||
                     upper({S.strip("json_extract_string(x, '$.label')")})), {NL} || {NL}) END AS few FROM v)
SELECT claim_id, {S.lit(SYSTEM_PROMPT)} AS system_content,
       CASE WHEN few IS NOT NULL THEN 'Few-shot examples:' || {NL} || few || {NL} || {NL} || 'Original input:' || {NL} || input
            ELSE input END AS user_content
FROM r"""
ORACLE_BODY["requests_code"] = f"""
SELECT t.task_id, CASE WHEN n.task_id IS NOT NULL THEN
         'Here are some examples:' || {NL} || {NL} || 'Example 1:' || {NL} || n.prompt || {NL} || {NL} || 'Solution:' || {NL} || n.test
         || {NL} || {NL} || '---' || {NL} || {NL} || 'Now solve this:' || {NL} || {NL} || t.prompt ELSE t.prompt END AS user_content
FROM v_code_tasks t LEFT JOIN v_code_tasks n ON n.task_id = t.task_id + 1"""
ORACLE_BODY["flatten_messages"] = f"""
SELECT conv_id, count(*) AS n_messages,
       string_agg('[' || {S.pystr('role')} || '] ' || {S.pystr('text')}, {NL} || {NL} ORDER BY turn, {S.pystr('role')}, {S.pystr('text')}) AS flat_text
FROM conversations GROUP BY conv_id"""

# ---------------------------------------------------------------- C
ORACLE_BODY["split_fraction"] = f"""WITH {TRAIN}
SELECT claim_id, rank, CASE WHEN claim_id IN (SELECT claim_id FROM v_train) THEN 'train' ELSE 'val' END AS split FROM v_rank"""
ORACLE_BODY["split_fixed"] = f"""WITH {TRAIN}
SELECT claim_id, rank, CASE WHEN rank <= 50 THEN 'train' WHEN rank <= 100 THEN 'val' ELSE 'test' END AS split FROM v_rank"""
ORACLE_BODY["sample_n"] = """
SELECT claim_id, sample_rank FROM (
  SELECT claim_id, row_number() OVER (ORDER BY md5('7|' || CAST(claim_id AS VARCHAR)), claim_id) AS sample_rank FROM v_claims)
WHERE sample_rank <= 100"""
ORACLE_BODY["head_pct"] = """
SELECT claim_id, position FROM (SELECT claim_id, row_number() OVER (ORDER BY claim_id) AS position FROM v_claims)
WHERE position <= (SELECT greatest(1, CAST(floor(count(*) * CAST(25 AS DOUBLE) / 100) AS BIGINT)) FROM v_claims)"""
ORACLE_BODY["holdout"] = f"""WITH {CLAIMS}, {TRAIN}
SELECT claim_id FROM v_fmt WHERE input NOT IN (SELECT f.input FROM v_fmt f JOIN v_train t ON f.claim_id = t.claim_id)"""
ORACLE_BODY["batch_ranges"] = """
SELECT (position - 1) // 50 AS batch, min(position) AS start, max(position) AS "end", count(*) AS n
FROM (SELECT claim_id, row_number() OVER (ORDER BY claim_id) AS position FROM v_claims) GROUP BY 1"""
ORACLE_BODY["remaining_work"] = """
SELECT c.claim_id, k.candidate_id FROM v_claims c CROSS JOIN v_candidates k
WHERE NOT EXISTS (SELECT 1 FROM v_responses r WHERE r.response <> '' AND r.claim_id = c.claim_id AND r.candidate_id = k.candidate_id)"""
MINIBATCH = """v_mb_p AS (
  SELECT n, CAST(ceil(n / 5.0) AS BIGINT) AS m FROM (SELECT count(*) AS n FROM v_claims)
), v_mb_r AS (
  SELECT e.range AS epoch, c.claim_id,
         row_number() OVER (PARTITION BY e.range ORDER BY md5('42|' || CAST(e.range AS VARCHAR) || '|' || CAST(c.claim_id AS VARCHAR)), c.claim_id) AS rk
  FROM range(0, 20) e CROSS JOIN v_claims c
  WHERE e.range < (SELECT CAST(ceil(20 / m) AS BIGINT) FROM v_mb_p)
), v_mb AS (
  SELECT epoch * m + (rk - 1) // 5 AS iteration, claim_id, (rk - 1) % 5 + 1 AS slot FROM v_mb_r, v_mb_p
  WHERE epoch * m + (rk - 1) // 5 < 20)"""
ORACLE_BODY["minibatches"] = f"WITH {MINIBATCH} SELECT iteration, claim_id, slot FROM v_mb"

# ---------------------------------------------------------------- D
ORACLE_BODY["evaluation_grid"] = "SELECT c.claim_id, k.candidate_id, k.prompt_type FROM v_claims c CROSS JOIN v_candidates k"
ORACLE_BODY["score_claims"] = f"""WITH {CLAIMS}, {SCORED}
SELECT claim_id, candidate_id, predicted_label, answer, correct, score FROM v_sc"""
ORACLE_BODY["attach_fewshot"] = """
WITH last AS (SELECT input AS k, arg_max(id, id) AS fewshot_id, arg_max(reply, id) AS few_shot FROM v_fewshot_gaps GROUP BY input)
SELECT c.claim_id, l.fewshot_id, l.few_shot, l.k IS NOT NULL AS attached FROM v_claims c LEFT JOIN last l ON c.evidence = l.k"""
ORACLE_BODY["merge_training"] = f"""WITH {TRAIN},
canon AS (SELECT c.evidence AS k, arg_max({S.gold('c.label_raw')}, c.claim_id) AS answer, max(c.claim_id) AS context_id
          FROM v_claims c JOIN v_train t ON c.claim_id = t.claim_id GROUP BY c.evidence)
SELECT f.id, CASE WHEN k.k IS NOT NULL THEN k.answer ELSE NULL END AS answer,
       CASE WHEN k.k IS NOT NULL THEN k.context_id ELSE NULL END AS context_id, k.k IS NOT NULL AS matched, f.reply AS few_shot
FROM v_fewshot_gaps f LEFT JOIN canon k ON f.input = k.k"""
ORACLE_BODY["fill_failures"] = f"""WITH {CLAIMS},
g AS (SELECT c.claim_id, k.candidate_id FROM v_claims c CROSS JOIN v_candidates k),
j AS (SELECT g.claim_id, g.candidate_id, r.response AS resp, r.claim_id IS NULL AS failed
      FROM g LEFT JOIN (SELECT * FROM v_responses WHERE response <> '') r ON g.claim_id = r.claim_id AND g.candidate_id = r.candidate_id),
p AS (SELECT j.claim_id, j.candidate_id, CASE WHEN failed THEN '' ELSE coalesce(resp, '') END AS response, failed,
             CASE WHEN failed THEN 'NOT_SUPPORTED' ELSE {S.verdict("coalesce(resp, '')")} END AS predicted_label, f.answer
      FROM j LEFT JOIN v_fmt f ON j.claim_id = f.claim_id)
SELECT claim_id, candidate_id, response, failed, predicted_label,
       CASE WHEN failed THEN CAST(0.0 AS DOUBLE) WHEN {S.label_match('predicted_label', 'answer')} THEN CAST(1.0 AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END AS score FROM p"""
ORACLE_BODY["error_guidance"] = f"""
SELECT task_id, candidate_id, sample_idx, {STATUS} AS status, error_type,
       {guidance_sql(STATUS, 'error_type', True)} AS guidance_key, {guidance_sql(STATUS, 'error_type', False)} AS guidance
FROM v_generations WHERE NOT passed"""

ORACLE_BODY["error_guidance_table"] = f"""WITH g AS ({ORACLE_BODY["error_guidance"]}),
e AS (SELECT DISTINCT error_type FROM v_generations WHERE NOT passed AND error_type IS NOT NULL),
m AS (SELECT g.task_id, g.candidate_id, g.sample_idx, min(upper(e.error_type)) AS rule, min_by(e.error_type, upper(e.error_type)) AS own
      FROM g JOIN e ON contains(lower(coalesce(g.status, '')), lower(e.error_type)) OR contains(lower(coalesce(g.error_type, '')), lower(e.error_type)) GROUP BY ALL)
SELECT g.task_id, g.candidate_id, g.sample_idx, g.status, g.error_type,
       CASE WHEN guidance_key = 'default' AND m.rule IS NOT NULL THEN m.rule ELSE guidance_key END AS guidance_key,
       CASE WHEN guidance_key = 'default' AND m.rule IS NOT NULL THEN 'see ' || m.own ELSE guidance END AS guidance
FROM g LEFT JOIN m ON g.task_id = m.task_id AND g.candidate_id = m.candidate_id AND g.sample_idx = m.sample_idx"""

# ---------------------------------------------------------------- E
ORACLE_BODY["parse_verdicts"] = f"SELECT claim_id, candidate_id, response, {S.verdict('response')} AS predicted_label FROM v_responses"
ORACLE_BODY["extract_code"] = f"WITH {EXTRACT} SELECT reply_id, entry_point, code FROM v_code"
ORACLE_BODY["classify_generations"] = f"""WITH {EXTRACT},
j AS (SELECT c.reply_id, c.task_id, t.entry_point, c.code, t.test, r.passed AS rp, r.error_type AS re, r.error_message AS rm, r.reply_id IS NOT NULL AS has
      FROM v_code c LEFT JOIN v_code_tasks t ON c.task_id = t.task_id LEFT JOIN v_exec_results r ON c.reply_id = r.reply_id),
k AS (SELECT reply_id, task_id, entry_point,
        CASE WHEN coalesce(test, '') = '' THEN 'No test code provided for this problem'
             WHEN NOT contains(coalesce(code, ''), coalesce(entry_point, '')) THEN 'Function ' || chr(39) || entry_point || chr(39) || ' not found in generated code'
             WHEN NOT has THEN 'No execution result' ELSE rm END AS error_message,
        CASE WHEN coalesce(test, '') = '' OR NOT contains(coalesce(code, ''), coalesce(entry_point, '')) OR NOT has THEN false ELSE rp END AS passed,
        CASE WHEN coalesce(test, '') = '' THEN 'NoTestCode' WHEN NOT contains(coalesce(code, ''), coalesce(entry_point, '')) THEN 'MissingFunction'
             WHEN NOT has THEN 'UnknownError' ELSE re END AS error_type
      FROM j)
SELECT reply_id, task_id, entry_point, passed, error_type, error_message, {STATUS} AS status FROM k"""
ORACLE_BODY["status_taxonomy"] = f"SELECT task_id, candidate_id, sample_idx, error_type, {STATUS} AS status FROM v_generations"

# ---------------------------------------------------------------- F
ORACLE_BODY["accuracy"] = f"""WITH {CLAIMS}, {SCORED}
SELECT candidate_id, count_if(correct) AS correct, count(*) AS total,
       CASE WHEN count(*) > 0 THEN count_if(correct) / count(*) ELSE CAST(0.0 AS DOUBLE) END AS accuracy
FROM v_sc GROUP BY candidate_id"""
ORACLE_BODY["label_distribution"] = f"""WITH {CLAIMS}, {SCORED},
p AS (SELECT candidate_id, count_if(predicted_label = 'SUPPORTED') AS ps, count_if(predicted_label = 'NOT_SUPPORTED') AS pn FROM v_sc GROUP BY 1),
a AS (SELECT count_if(answer = 'SUPPORTED') AS a_s, count_if(answer = 'NOT_SUPPORTED') AS a_n FROM v_fmt)
SELECT candidate_id, 'SUPPORTED' AS label, ps AS predicted, a_s AS actual FROM p, a
UNION ALL SELECT candidate_id, 'NOT_SUPPORTED' AS label, pn AS predicted, a_n AS actual FROM p, a"""
ORACLE_BODY["pass_at_1"] = """
SELECT candidate_id, count_if(coalesce(passed, false)) AS passed, count(*) AS total,
       CASE WHEN count(*) > 0 THEN count_if(coalesce(passed, false)) / count(*) ELSE CAST(0.0 AS DOUBLE) END AS pass_at_1
FROM v_generations WHERE sample_idx = 1 GROUP BY candidate_id"""
ORACLE_BODY["error_distribution"] = """
SELECT candidate_id, error_type, count(*) AS n FROM v_generations WHERE NOT coalesce(passed, false)
GROUP BY candidate_id, error_type"""
ORACLE_BODY["error_distribution_first"] = """
SELECT candidate_id, error_type, count(*) AS n FROM v_generations WHERE sample_idx = 1 AND NOT coalesce(passed, false)
GROUP BY candidate_id, error_type"""
ORACLE_BODY["pass_at_k"] = """
WITH t AS (SELECT candidate_id, task_id,
                  bool_or(coalesce(passed, false) AND sample_idx <= 1) AS s1, bool_or(coalesce(passed, false) AND sample_idx <= 3) AS s3,
                  bool_or(coalesce(passed, false) AND sample_idx <= 5) AS s5
           FROM v_generations GROUP BY candidate_id, task_id)
SELECT candidate_id, count(*) AS n_tasks, count_if(s1) AS solved_at_1, count_if(s3) AS solved_at_3, count_if(s5) AS solved_at_5,
       count_if(s1) / count(*) AS pass_at_1, count_if(s3) / count(*) AS pass_at_3, count_if(s5) / count(*) AS pass_at_5
FROM t GROUP BY candidate_id"""
ORACLE_BODY["sample_report"] = """
SELECT candidate_id, task_id, count_if(coalesce(passed, false)) AS samples_passed, count(*) AS samples,
       bool_or(coalesce(passed, false)) AS solved,
       string_agg(CAST(sample_idx AS VARCHAR) || ':' || CASE WHEN coalesce(passed, false) THEN 'P' ELSE 'F' END ||
                  coalesce('(' || error_type || ')', ''), ',' ORDER BY sample_idx) AS sample_text
FROM v_generations WHERE sample_idx <= 5 GROUP BY candidate_id, task_id"""
ORACLE_BODY["candidate_scores"] = f"WITH {CLAIMS}, {SCORED}, {CAND_SCORES} SELECT * FROM v_cs"
ORACLE_BODY["best_candidate"] = f"""WITH {CLAIMS}, {SCORED}, {CAND_SCORES}
SELECT (SELECT candidate_id FROM v_cs ORDER BY val_score DESC, candidate_id LIMIT 1) AS best_candidate_id,
       (SELECT max(val_score) FROM v_cs) AS best_score"""
ORACLE_BODY["instance_frontier"] = f"""WITH {CLAIMS}, {SCORED}, {FRONTIER}
SELECT claim_id, best_score, array_to_string(list_transform(fl, lambda x: CAST(x AS VARCHAR)), ',') AS frontier,
       CAST(len(fl) AS INTEGER) AS frontier_size FROM v_fr"""
FRONTIER_SCORE = """v_fs AS (
  SELECT count(*) AS n_examples,
         CASE WHEN count(*) > 0 THEN count_if(len(fl) > 0) / count(*) ELSE CAST(0.0 AS DOUBLE) END AS frontier_score,
         CASE WHEN count(*) > 0 THEN count_if(best_score > 0) / count(*) ELSE CAST(0.0 AS DOUBLE) END AS solved_by_any
  FROM v_fr)"""
ORACLE_BODY["frontier_score"] = f"WITH {CLAIMS}, {SCORED}, {FRONTIER}, {FRONTIER_SCORE} SELECT * FROM v_fs"
ORACLE_BODY["frontier_coverage"] = f"""WITH {CLAIMS}, {SCORED}, {FRONTIER},
w AS (SELECT unnest(fl) AS candidate_id FROM v_fr)
SELECT k.candidate_id, CAST(coalesce((SELECT count(*) FROM w WHERE w.candidate_id = k.candidate_id), 0) AS BIGINT) AS n_wins
FROM v_candidates k"""
ORACLE_BODY["frontier_bitmaps"] = ORACLE_BODY["frontier_coverage"]
UNDOMINATED = """v_w AS (SELECT claim_id, unnest(fl) AS candidate_id FROM v_fr),
v_n AS (SELECT candidate_id, count(*) AS n_wins FROM v_w GROUP BY candidate_id),
v_m AS (SELECT candidate_id, sum(score) / count(score) AS val_score FROM v_sc GROUP BY candidate_id),
v_b AS (SELECT a.candidate_id, b.candidate_id AS o, count(*) AS n FROM v_w a JOIN v_w b ON a.claim_id = b.claim_id AND a.candidate_id <> b.candidate_id GROUP BY ALL),
v_u AS (SELECT n.candidate_id, n.n_wins, m.val_score FROM v_n n JOIN v_m m USING (candidate_id)
        WHERE NOT EXISTS (SELECT 1 FROM v_b b JOIN v_n p ON p.candidate_id = b.o JOIN v_m q ON q.candidate_id = b.o WHERE b.candidate_id = n.candidate_id AND b.n = n.n_wins
                          AND (p.n_wins > n.n_wins OR q.val_score > m.val_score OR (q.val_score = m.val_score AND b.o < n.candidate_id))))"""
ORACLE_BODY["undominated_candidates"] = f"WITH {CLAIMS}, {SCORED}, {FRONTIER}, {UNDOMINATED} SELECT candidate_id, n_wins, val_score FROM v_u"
ORACLE_BODY["select_parents"] = f"""WITH {CLAIMS}, {SCORED}, {FRONTIER}, {UNDOMINATED},
k AS (SELECT r.range AS iteration, candidate_id, n_wins,
             -ln((CAST(CAST('0x' || substr(md5('42|' || r.range || '|' || candidate_id), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710656.0) / n_wins AS e
      FROM v_u CROSS JOIN range(1, 51) r),
o AS (SELECT iteration, CAST(row_number() OVER (PARTITION BY iteration ORDER BY e, candidate_id) AS INTEGER) AS draw, candidate_id, n_wins FROM k)
SELECT * FROM o WHERE draw <= 2"""
ORACLE_BODY["minibatch_gate"] = f"""WITH {CLAIMS}, {SCORED}, {MINIBATCH},
pairs AS (SELECT CAST(candidate_id - 1 AS BIGINT) AS iteration, candidate_id, candidate_id - 1 AS parent_id FROM v_candidates WHERE candidate_id > 0)
SELECT p.iteration, p.candidate_id, p.parent_id,
       sum(coalesce(sn.score, 0.0)) AS new_score, sum(coalesce(sp.score, 0.0)) AS parent_score, count(*) AS n,
       sum(coalesce(sn.score, 0.0)) > sum(coalesce(sp.score, 0.0)) AS promote
FROM v_mb m JOIN pairs p ON m.iteration = p.iteration
LEFT JOIN v_sc sn ON sn.claim_id = m.claim_id AND sn.candidate_id = p.candidate_id
LEFT JOIN v_sc sp ON sp.claim_id = m.claim_id AND sp.candidate_id = p.parent_id
GROUP BY p.iteration, p.candidate_id, p.parent_id"""
ORACLE_BODY["score_progression"] = f"""WITH {CLAIMS}, {SCORED}, {CAND_SCORES}
SELECT candidate_id, val_score, lag(val_score) OVER (ORDER BY candidate_id) AS prev_score,
       val_score - lag(val_score) OVER (ORDER BY candidate_id) AS delta,
       max(val_score) OVER (ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM v_cs"""

# ---------------------------------------------------------------- G
ORACLE_BODY["compare_variants"] = f"""WITH {COMPARE}
SELECT run_id, variant, correct, total, accuracy, delta_absolute, delta_percent, additional_correct FROM v_cmp2"""
ORACLE_BODY["verdict"] = f"""WITH {COMPARE}
SELECT run_id, variant,
       CASE WHEN correct * baseline_total > baseline_correct * total THEN 'IMPROVED'
            WHEN correct * baseline_total = baseline_correct * total THEN 'NO_CHANGE' ELSE 'DEGRADED' END AS verdict,
       {S.pct_string('correct', 'total')} AS accuracy_pct, {S.pct_string('baseline_correct', 'baseline_total')} AS baseline_pct,
       {S.pct_string('(correct * baseline_total - baseline_correct * total)', '(total * baseline_total)')} AS improvement_pct
FROM v_cmp2"""
ORACLE_BODY["comparison_wide"] = f"""WITH {COMPARE}
SELECT run_id, {", ".join(f"max(accuracy) FILTER (WHERE variant = '{v}') AS acc_{v}, max(delta_absolute) FILTER (WHERE variant = '{v}') AS delta_{v}" for v in "12345")}
FROM v_cmp2 GROUP BY run_id"""
ORACLE_BODY["run_summary"] = f"""WITH {CLAIMS}, {SCORED}, {CAND_SCORES}, {FRONTIER}, {FRONTIER_SCORE},
s AS (SELECT (SELECT candidate_id FROM v_cs ORDER BY val_score DESC, candidate_id LIMIT 1) AS best_candidate_id,
             (SELECT max(val_score) FROM v_cs) AS best_score, (SELECT max(val_score) FROM v_cs WHERE candidate_id = 0) AS seed_score,
             (SELECT count(*) FROM v_cs) AS num_candidates)
SELECT best_candidate_id, best_score, seed_score, num_candidates, best_score - seed_score AS improvement,
       CASE WHEN seed_score > 0 THEN (best_score - seed_score) / seed_score * 100 ELSE CAST(0.0 AS DOUBLE) END AS improvement_pct,
       n_examples, frontier_score, solved_by_any, frontier_score - best_score AS frontier_improvement
FROM s, v_fs"""
ORACLE_BODY["latest_run"] = f"""WITH {COMPARE}
SELECT variant, arg_max(run_id, run_id) AS latest_run_id, arg_max(accuracy, run_id) AS accuracy FROM v_cmp2 GROUP BY variant"""
ORACLE_BODY["leaderboard"] = f"""WITH {COMPARE},
p AS (SELECT run_id, arg_min(variant, (-accuracy, variant)) AS best_variant, max(accuracy) AS best_accuracy,
             max(accuracy) FILTER (WHERE variant = '1') AS baseline_accuracy FROM v_cmp2 GROUP BY run_id)
SELECT run_id, best_variant, best_accuracy, baseline_accuracy, best_accuracy - baseline_accuracy AS gain,
       CAST(dense_rank() OVER (ORDER BY best_accuracy DESC) AS INTEGER) AS rank FROM p"""
ORACLE_BODY["candidate_comparison"] = f"""WITH {CLAIMS}, {SCORED},
a AS (SELECT candidate_id, count_if(correct) AS correct, count(*) AS total,
             CASE WHEN count(*) > 0 THEN count_if(correct) / count(*) ELSE CAST(0.0 AS DOUBLE) END AS accuracy FROM v_sc GROUP BY 1),
b AS (SELECT accuracy AS ba, correct AS bc, total AS bt FROM a WHERE candidate_id = 0)
SELECT candidate_id, correct, total, accuracy, accuracy - ba AS delta_absolute,
       CASE WHEN ba <> 0 THEN (accuracy - ba) / ba * 100 ELSE NULL END AS delta_percent, correct - bc AS additional_correct,
       CASE WHEN correct * bt > bc * total THEN 'IMPROVED' WHEN correct * bt = bc * total THEN 'NO_CHANGE' ELSE 'DEGRADED' END AS verdict,
       {S.pct_string('correct', 'total')} AS accuracy_pct, {S.pct_string('(correct * bt - bc * total)', '(total * bt)')} AS improvement_pct
FROM a LEFT JOIN b ON true"""
ORACLE_BODY["claims_feedback"] = f"""WITH {CLAIMS}, {SCORED}
SELECT s.claim_id, s.candidate_id, CASE WHEN s.score > 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS status, s.predicted_label, s.answer,
       CASE WHEN s.score > 0 THEN 'CORRECT' ELSE 'INCORRECT' END || ': Model predicted "' || {S.pystr('s.predicted_label')} ||
       '", correct answer is "' || {S.pystr('s.answer')} || '".' || {NL} || {NL} || 'Input: ' || {S.pystr('f.input')} || {NL} || {NL} ||
       'Response: ' || {S.pystr('s.response')} || {NL} || {NL} || {S.lit(CLAIMS_FEEDBACK_NOTES)} AS feedback,
       s.score, 'system_prompt' AS component
FROM v_sc s JOIN v_fmt f ON s.claim_id = f.claim_id"""
ORACLE_BODY["code_feedback"] = f"""
WITH g AS (SELECT *, {STATUS} AS exec_status, CASE WHEN passed THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score
           FROM v_code_generations)
SELECT CASE WHEN score > 0 THEN 'PASSED' ELSE 'FAILED' END AS status, task_id, entry_point, prompt AS problem, code AS generated_code,
       exec_status AS execution_status, error_type, error_message, traceback,
       CASE WHEN score > 0 THEN
         'PASSED: Task ' || {S.pystr('task_id')} || {NL} || {NL} || 'The generated code for function `' || {S.pystr('entry_point')} ||
         '` passed all tests.' || {NL} || {NL} || 'Generated Code:' || {NL} || '```python' || {NL} || {S.pystr('code')} || {NL} || '```' ||
         {NL} || {NL} || {S.lit(CODE_PASS_NOTES)}
       ELSE concat_ws({NL},
         'FAILED: Task ' || {S.pystr('task_id')}, 'Function: `' || {S.pystr('entry_point')} || '`',
         'Execution Status: ' || {S.pystr('exec_status')}, 'Error Type: ' || {S.pystr('error_type')},
         'Error Message: ' || {S.pystr('error_message')},
         {NL} || 'Problem:' || {NL} || {S.preview(S.pystr('prompt'), 500)},
         {NL} || 'Generated Code:' || {NL} || '```python' || {NL} || {S.preview(S.pystr('code'), 800)} || {NL} || '```',
         CASE WHEN coalesce(traceback, '') <> '' THEN {NL} || 'Traceback:' || {NL} || {S.preview('traceback', 600)} END,
         {NL} || 'Guidance:' || {NL} || {guidance_sql('exec_status', 'error_type', False)})
       END AS feedback,
       score, candidate_id, sample_idx, 'system_prompt' AS component
FROM g"""
ORACLE_BODY["failure_digest"] = f"""WITH {EXEC}
SELECT task_id, candidate_id, sample_idx,
       CASE WHEN coalesce(passed, false) THEN 'PASSED: All tests passed successfully.' ELSE concat_ws({NL} || {NL},
         'FAILED: ' || {S.pystr('status')},
         CASE WHEN coalesce(error_type, '') <> '' THEN 'Error Type: ' || error_type END,
         CASE WHEN coalesce(error_message, '') <> '' THEN 'Error Message: ' || error_message END,
         CASE WHEN coalesce(traceback, '') <> '' THEN 'Traceback:' || {NL} ||
              CASE WHEN length(traceback) > 1000 THEN substr(traceback, 1, 1000) || {NL} || '... (truncated)' ELSE traceback END END,
         CASE WHEN {S.strip("coalesce(stdout, '')")} <> '' THEN 'Stdout:' || {NL} || substr(stdout, 1, 500) END,
         CASE WHEN {S.strip("coalesce(stderr, '')")} <> '' THEN 'Stderr:' || {NL} || substr(stderr, 1, 500) END) END AS digest
FROM v_st"""
ORACLE_BODY["extract_failures"] = f"WITH {FAILURES} SELECT * FROM v_fail"
ORACLE_BODY["reflection_requests"] = f"""WITH {FAILURES}
SELECT failure_idx, {S.lit(REFLECTION_HEADER)} || {NL} || {NL} || 'Task Context:' || {NL} || '- Task ID: ' || {S.pystr('task_id')} ||
       {NL} || '- Function/Entry Point: ' || {S.pystr('entry_point')} || {NL} || '- Error Type: ' || {S.pystr('error_type')} ||
       {NL} || '- Error Message: ' || {S.pystr('error_message')} || {NL} || {NL} || 'Failure Signal Details:' || {NL} ||
       CASE WHEN coalesce(traceback, '') <> '' THEN 'Traceback: ' || traceback ELSE '' END || {NL} ||
       CASE WHEN coalesce(guidance, '') <> '' THEN 'Guidance: ' || guidance ELSE '' END || {NL} || {NL} || {S.lit(REFLECTION_FOOTER)} AS request
FROM v_fail"""
ORACLE_BODY["parse_reflections"] = f"WITH {REFL} SELECT event_id, has_change, change_raw, change, analysis, priority FROM v_pr3"
ORACLE_BODY["reflection_summary"] = f"""WITH {REFL}
SELECT e.run_name, count(*) AS failures_found, count_if(r.event_id IS NOT NULL AND o.reflector_output IS NOT NULL) AS reflections_generated,
       count_if(coalesce(r.has_change, false)) AS suggestions, count(DISTINCT e.error_type) AS n_error_types
FROM v_event_log e LEFT JOIN v_pr3 r ON e.event_id = r.event_id LEFT JOIN v_reflections o ON e.event_id = o.event_id
WHERE e.event_type = 'reflector_invocation' GROUP BY e.run_name"""
ORACLE_BODY["error_shift"] = """
SELECT error_type, count_if(candidate_id = 0) AS seed_failures, count_if(candidate_id = 1) AS optimized_failures,
       count_if(candidate_id = 1) - count_if(candidate_id = 0) AS change
FROM v_generations WHERE NOT coalesce(passed, false) GROUP BY error_type"""
ORACLE_BODY["error_shift_first"] = """
SELECT error_type, count_if(candidate_id = 0) AS seed_failures, count_if(candidate_id = 1) AS optimized_failures,
       count_if(candidate_id = 1) - count_if(candidate_id = 0) AS change
FROM v_generations WHERE sample_idx = 1 AND NOT coalesce(passed, false) GROUP BY error_type"""

# ---------------------------------------------------------------- H
ORACLE_BODY["token_rollup"] = """
SELECT run_name, error_type, count(*) AS n_calls, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens, max(total_tokens) AS max_tokens,
       CAST(grouping_id(run_name, error_type) AS INTEGER) AS level, CAST(sum(total_tokens) AS DOUBLE) / count(*) AS avg_tokens
FROM v_event_log WHERE event_type = 'reflector_invocation' GROUP BY ROLLUP (run_name, error_type)"""
ORACLE_BODY["batch_audit"] = """
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'batch_start' THEN 1 ELSE 0 END) OVER (
             PARTITION BY run_name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch_seq FROM v_event_log),
b AS (SELECT run_name, CAST(batch_seq AS BIGINT) AS batch_seq, min(ts) FILTER (WHERE event_type = 'batch_start') AS s,
             min(ts) FILTER (WHERE event_type = 'batch_complete') AS d,
             count_if(event_type = 'reflector_invocation') AS n_invocations, count_if(event_type = 'batch_complete') AS n_completes
      FROM e GROUP BY run_name, batch_seq)
SELECT run_name, batch_seq, n_invocations, n_completes, n_completes > 0 AS complete, date_diff('microsecond', s, d) AS duration_us FROM b"""
ORACLE_BODY["stream_batch_audit"] = """
WITH e AS (SELECT *, epoch_us(ts) AS us, sum(CASE WHEN event_type = 'batch_start' THEN 1 ELSE 0 END) OVER (
             PARTITION BY run_name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch_seq FROM v_event_log),
w AS (SELECT max(us) // 1000 - 3600000 AS now FROM e),
b AS (SELECT run_name, CAST(batch_seq AS BIGINT) AS batch_seq, min(us) AS first_us, max(us) AS last_us, min(ts) FILTER (WHERE event_type = 'batch_start') AS s,
             min(ts) FILTER (WHERE event_type = 'batch_complete') AS d,
             count_if(event_type = 'reflector_invocation') AS n_invocations, count_if(event_type = 'batch_complete') AS n_completes
      FROM e GROUP BY run_name, batch_seq),
n AS (SELECT *, lead(first_us) OVER (PARTITION BY run_name ORDER BY batch_seq) AS next_us FROM b)
SELECT run_name, batch_seq, n_invocations, n_completes, n_completes > 0 AS complete, date_diff('microsecond', s, d) AS duration_us
FROM n, w WHERE next_us <= now * 1000 OR (next_us IS NULL AND last_us <= (now - 3600000) * 1000)"""
ORACLE_BODY["call_latency"] = """
SELECT event_id, run_name, date_diff('microsecond', lag(ts) OVER (PARTITION BY run_name ORDER BY ts, event_id), ts) AS gap_us FROM v_event_log"""
ORACLE_BODY["progress"] = """
WITH i AS (SELECT * FROM v_event_log WHERE event_type = 'reflector_invocation'),
r AS (SELECT event_id, run_name, count(*) OVER (PARTITION BY run_name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS processed,
             count(*) OVER (PARTITION BY run_name) AS total FROM i)
SELECT event_id, run_name, processed, total, CAST(floor(processed / total * 100) AS INTEGER) AS pct, processed % 10 = 0 AS milestone FROM r"""
ORACLE_BODY["latest_metric"] = """
SELECT name, max(step) AS latest_step, arg_max(value, (step, ts, event_id)) AS latest_value, count(*) AS n_points FROM v_metrics GROUP BY name"""


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's returns BIGINT. Wrap each call in a cast."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(tok) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(count_if(" + _bigint_counts(sql[j + len(tok):k]) + ") AS BIGINT)")
        i = k + 1


def oracle_sql() -> dict[str, str]:
    return {k: _bigint_counts(with_views(v)) for k, v in ORACLE_BODY.items()}

# ---------------------------------------------------------------- A
ORACLE_BODY["detailed_flatten"] = """
SELECT CASE candidate_id WHEN 0 THEN 'seed_results' ELSE 'optimized_results' END AS prompt_type, task_id, sample_idx, passed, error_type
FROM v_generations"""
ORACLE_BODY["split_roundtrip"] = """
SELECT CAST(task_id AS VARCHAR) AS task_id, coalesce(entry_point, '') AS entry_point, coalesce(prompt, '') AS input, '' AS answer,
       coalesce(test, '') AS test, coalesce(test, '') AS ctx_test FROM v_code_tasks"""
ORACLE_BODY["fewshot_roundtrip"] = f"""WITH src AS (SELECT * FROM v_fewshot), v AS ({_fewshot_valid('reply')})
SELECT id, CASE WHEN valid THEN CAST(json_array_length(j) AS INTEGER) END AS n_items, NOT valid AS is_raw,
       CASE WHEN valid THEN array_to_string(list_transform(json_extract(j, '$[*]'),
            lambda x: upper({S.strip("json_extract_string(x, '$.label')")})), ',') END AS labels,
       CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id AS VARCHAR) END AS ctx_id
FROM v"""


def _pick_sql(key: str, salt: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '0', CAST({key} AS VARCHAR), {salt})), 1, 8) AS BIGINT) % {n})"


def _sentence_sql(tag: str, lo: int, hi: int) -> str:
    from evalframe.functions.constants import SYNTHETIC_WORDS
    words = "[" + ", ".join(S.lit(w) for w in SYNTHETIC_WORDS) + "]"
    n = f"({_pick_sql('doc_id', S.lit(tag + '_n'), hi - lo + 1)} + {lo})"
    body = (f"array_to_string(list_transform(generate_series(1, {n}), lambda i: {words}[{_pick_sql('doc_id', f'{S.lit(tag + chr(95))} || CAST(i AS VARCHAR)', len(SYNTHETIC_WORDS))} + 1]), ' ')")
    return f"(upper(substr({body}, 1, 1)) || substr({body}, 2) || '.')"


ORACLE_BODY["synthetic_claims"] = f"""
SELECT doc_id AS id, 'Claim: ' || {_sentence_sql('claim', 6, 14)} || chr(10) || 'Context: ' || {_sentence_sql('context', 20, 40)} AS input,
       ['SUPPORTED', 'NOT_SUPPORTED'][{_pick_sql('doc_id', "'label'", 2)} + 1] AS answer
FROM documents"""

# ---------------------------------------------------------------- E6, H6, H7
ORACLE_BODY["predict_stub"] = f"""
SELECT claim_id, candidate_id, response, false AS failed, CAST(NULL AS VARCHAR) AS error, {S.verdict('response')} AS predicted_label FROM v_replies"""
ORACLE_BODY["stream_accuracy"] = ORACLE_BODY["accuracy"]
ORACLE_BODY["stream_windows"] = """
WITH e AS (SELECT run_name, epoch_us(ts) AS us, total_tokens FROM v_event_log),
t AS (SELECT 'tumbling' AS kind, run_name, (us // 3600000000) * 3600000000 AS window_start_us,
             (us // 3600000000) * 3600000000 + 3600000000 AS window_end_us, count(*) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS tokens
      FROM e GROUP BY ALL),
s AS (SELECT 'sliding' AS kind, run_name, (us // 3600000000 - o) * 3600000000 AS window_start_us,
             (us // 3600000000 - o) * 3600000000 + 7200000000 AS window_end_us, count(*) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS tokens
      FROM e CROSS JOIN (VALUES (0), (1)) k(o) GROUP BY ALL),
q AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run_name ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS new FROM e),
q2 AS (SELECT *, sum(new) OVER (PARTITION BY run_name ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM q),
se AS (SELECT 'session' AS kind, run_name, min(us) AS window_start_us, max(us) + 1800000000 AS window_end_us, count(*) AS n_events,
              CAST(sum(total_tokens) AS BIGINT) AS tokens FROM q2 GROUP BY run_name, sid)
SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT kind, run_name, window_start_us, window_end_us, n_events, tokens FROM se"""

ORACLE_BODY["code_comparison"] = f"""
WITH t AS (SELECT candidate_id, task_id,
                  bool_or(coalesce(passed, false) AND sample_idx <= 1) AS s1, bool_or(coalesce(passed, false) AND sample_idx <= 3) AS s3,
                  bool_or(coalesce(passed, false) AND sample_idx <= 5) AS s5
           FROM v_generations GROUP BY candidate_id, task_id),
p AS (SELECT candidate_id, count(*) AS n, count_if(s1) AS c1, count_if(s1) / count(*) AS p1, count_if(s3) / count(*) AS p3,
             count_if(s5) / count(*) AS p5 FROM t GROUP BY candidate_id),
a AS (SELECT max(n) FILTER (WHERE candidate_id = 0) AS seed_total, max(n) FILTER (WHERE candidate_id = 1) AS optimized_total,
             max(p1) FILTER (WHERE candidate_id = 0) AS seed_pass_at_1, max(p1) FILTER (WHERE candidate_id = 1) AS optimized_pass_at_1,
             max(p3) FILTER (WHERE candidate_id = 0) AS seed_pass_at_3, max(p3) FILTER (WHERE candidate_id = 1) AS optimized_pass_at_3,
             max(p5) FILTER (WHERE candidate_id = 0) AS seed_pass_at_5, max(p5) FILTER (WHERE candidate_id = 1) AS optimized_pass_at_5,
             max(c1) FILTER (WHERE candidate_id = 0) AS seed_passed, max(c1) FILTER (WHERE candidate_id = 1) AS optimized_passed FROM p)
SELECT *, optimized_pass_at_1 - seed_pass_at_1 AS absolute_improvement,
       CASE WHEN seed_pass_at_1 > 0 THEN (optimized_pass_at_1 - seed_pass_at_1) / seed_pass_at_1 * 100 ELSE CAST(0.0 AS DOUBLE) END
         AS relative_improvement_percent,
       optimized_passed - seed_passed AS additional_problems_solved,
       optimized_pass_at_3 - seed_pass_at_3 AS pass_at_3_improvement, optimized_pass_at_5 - seed_pass_at_5 AS pass_at_5_improvement,
       CASE WHEN optimized_passed * seed_total > seed_passed * optimized_total THEN 'IMPROVED'
            WHEN optimized_passed * seed_total < seed_passed * optimized_total THEN 'DEGRADED' ELSE 'NO_CHANGE' END AS verdict,
       {S.pct_string('(optimized_passed * seed_total - seed_passed * optimized_total)', '(seed_total * optimized_total)', signed=True)} AS improvement
FROM a"""

# the evaluation flow with the fixture's reply table as its model: the flagship comparison over all calls, failed ones read as ''
ORACLE_BODY["claims_evaluation"] = ORACLE_BODY["candidate_comparison"].replace("FROM v_responses r LEFT JOIN", """FROM (
    SELECT claim_id, candidate_id, CASE WHEN (claim_id + candidate_id) % 11 = 10 THEN '' ELSE response END AS response FROM v_replies) r LEFT JOIN""")
assert "v_replies" in ORACLE_BODY["claims_evaluation"]

ORACLE_BODY["code_evaluation"] = f"""
WITH g AS (SELECT t.task_id, k.candidate_id, s.range AS sample_idx, t.entry_point, t.test,
                  CASE (t.task_id + 3 * k.candidate_id + s.range) % 4
                    WHEN 0 THEN '```python' || chr(10) || 'def f' || CAST(t.task_id AS VARCHAR) || '(x):' || chr(10) || '    return 1' || chr(10) || '```'
                    WHEN 1 THEN '```python' || chr(10) || 'def f' || CAST(t.task_id AS VARCHAR) || '(x):' || chr(10) || '    return 0' || chr(10) || '```'
                    WHEN 2 THEN 'def g(x): return 1'
                    ELSE '```' || chr(10) || 'py' || chr(10) || 'def f' || CAST(t.task_id AS VARCHAR) || '(x): return 1' || chr(10) || '```' END AS reply
           FROM v_code_tasks t CROSS JOIN v_candidates k CROSS JOIN range(1, 6) s),
{extract_cte("g", "task_id, candidate_id, sample_idx, entry_point, test", name="gc")},
c AS (SELECT *, CASE WHEN coalesce(test, '') = '' THEN false WHEN NOT contains(coalesce(code, ''), coalesce(entry_point, '')) THEN false
                     ELSE contains(code, 'return 1') END AS passed FROM gc),
t AS (SELECT candidate_id, task_id,
             bool_or(passed AND sample_idx <= 1) AS s1, bool_or(passed AND sample_idx <= 3) AS s3, bool_or(passed AND sample_idx <= 5) AS s5
      FROM c GROUP BY candidate_id, task_id)
SELECT candidate_id, count(*) AS n_tasks, count_if(s1) AS solved_at_1, count_if(s3) AS solved_at_3, count_if(s5) AS solved_at_5,
       count_if(s1) / count(*) AS pass_at_1, count_if(s3) / count(*) AS pass_at_3, count_if(s5) / count(*) AS pass_at_5
FROM t GROUP BY candidate_id"""

ORACLE_BODY["stream_scored_append"] = ORACLE_BODY["score_claims"]

ORACLE_BODY["reflection_flow"] = f"""WITH {FAILURES}
SELECT failure_idx, task_id, error_type, true AS has_change, 'handle ' || {S.pystr('error_type')} AS change,
       CASE WHEN failure_idx % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS priority, {S.pystr('error_type')} || ' seen' AS analysis
FROM v_fail"""

_LANDED = "CASE WHEN (claim_id + candidate_id) % 11 = 10 THEN '' ELSE response END"
ORACLE_BODY["claims_evaluation_resumed"] = f"""WITH {CLAIMS},
r AS (SELECT claim_id, candidate_id, (claim_id + candidate_id) % 11 = 10 AS failed, {S.verdict(_LANDED)} AS predicted_label FROM v_replies)
SELECT r.claim_id, r.candidate_id, r.failed, r.predicted_label,
       CASE WHEN r.failed THEN CAST(0.0 AS DOUBLE) WHEN {S.label_match('r.predicted_label', 'f.answer')} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score
FROM r LEFT JOIN v_fmt f ON r.claim_id = f.claim_id"""
_ANSWERED = ORACLE_BODY["claims_evaluation_resumed"].replace(_LANDED, "response").replace("(claim_id + candidate_id) % 11 = 10 AS failed", "false AS failed")
ORACLE_BODY["resume_after_failure"] = f"""WITH o AS ({_ANSWERED})
SELECT candidate_id, CAST(sum(score) AS BIGINT) AS correct, count(*) AS total, (SELECT count(*) FROM o) AS n_calls, CAST(0 AS BIGINT) AS n_called_twice FROM o GROUP BY candidate_id"""
ORACLE_BODY["resume_changed_prompt"] = f"""SELECT candidate_id, correct, total FROM ({ORACLE_BODY["claims_evaluation"]})"""
ORACLE_BODY["resume_retries_failed"] = """WITH o AS (SELECT candidate_id, (claim_id + candidate_id) % 11 = 10 AS failed FROM v_replies)
SELECT candidate_id, count(*) AS n_outputs, CAST(0 AS BIGINT) AS n_failed, nullif(count_if(failed), 0) AS n_failed_before,
       (SELECT count(*) + count_if(failed) FROM o) AS n_attempts, (SELECT count_if(failed) FROM o) AS n_failed_attempts FROM o GROUP BY candidate_id"""
ORACLE_BODY["reflection_resumed"] = f"""WITH {FAILURES}
SELECT failure_idx, task_id, error_type, 'handle ' || {S.pystr('error_type')} || ' of ' || {S.pystr('task_id')} AS change, (SELECT count(*) FROM v_fail) AS n_calls
FROM v_fail"""
ORACLE_BODY["event_log_roundtrip"] = """
SELECT run_name, error_type, count(*) AS n_calls, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens,
       CAST(grouping_id(run_name, error_type) AS INTEGER) AS level
FROM v_event_log WHERE event_type = 'reflector_invocation' GROUP BY ROLLUP (run_name, error_type)"""
ORACLE_BODY["reflection_list"] = f"""WITH {REFL}
SELECT e.run_name, e.event_id, e.task_id, e.error_type, coalesce(r.change_raw, 'See log') AS mutation_suggested
FROM v_event_log e LEFT JOIN v_pr3 r ON e.event_id = r.event_id WHERE e.event_type = 'reflector_invocation'"""
ORACLE_BODY["comparison_documents"] = f"""WITH {COMPARE},
n AS (SELECT run_id, total AS test_size FROM v_cmp2 WHERE variant = '1')
SELECT c.run_id, n.test_size, CASE variant WHEN '1' THEN 'baseline' WHEN '2' THEN 'optimized' ELSE 'fewshot_optimized' END AS variant, accuracy AS score,
       correct, total, CASE WHEN variant <> '1' THEN delta_absolute END AS delta_absolute, CASE WHEN variant <> '1' THEN delta_percent END AS delta_percent
FROM v_cmp2 c LEFT JOIN n ON c.run_id = n.run_id WHERE variant IN ('1', '2', '3')"""
_ONE = lambda side, cid: ", ".join(
    [f"max(a.accuracy) FILTER (WHERE a.candidate_id = {cid}) AS {side}_accuracy", f"max(a.correct) FILTER (WHERE a.candidate_id = {cid}) AS {side}_correct",
     f"max(a.total) FILTER (WHERE a.candidate_id = {cid}) AS {side}_total", f"max(a.ps) FILTER (WHERE a.candidate_id = {cid}) AS {side}_predicted_supported",
     f"max(a.pn) FILTER (WHERE a.candidate_id = {cid}) AS {side}_predicted_not_supported", f"max(g.s) AS {side}_actual_supported", f"max(g.n) AS {side}_actual_not_supported"])
ORACLE_BODY["report_doc"] = f"""WITH {CLAIMS}, {SCORED},
a AS (SELECT candidate_id, count_if(correct) AS correct, count(*) AS total, count_if(correct) / count(*) AS accuracy,
             count_if(predicted_label = 'SUPPORTED') AS ps, count_if(predicted_label = 'NOT_SUPPORTED') AS pn FROM v_sc GROUP BY 1),
g AS (SELECT count_if(answer = 'SUPPORTED') AS s, count_if(answer = 'NOT_SUPPORTED') AS n FROM v_fmt),
o AS (SELECT {_ONE('seed', 0)}, {_ONE('optimized', 1)} FROM a, g)
SELECT *, seed_total AS test_set_size, optimized_accuracy - seed_accuracy AS accuracy_improvement,
       CASE WHEN seed_accuracy > 0 THEN (optimized_accuracy - seed_accuracy) / seed_accuracy * 100 ELSE CAST(0.0 AS DOUBLE) END AS accuracy_improvement_percentage,
       optimized_correct - seed_correct AS additional_correct_predictions,
       {S.pct_string('seed_correct', 'seed_total')} AS seed_pct, {S.pct_string('optimized_correct', 'optimized_total')} AS optimized_pct,
       {S.pct_string('optimized_correct', 'optimized_total')} || ' vs ' || {S.pct_string('seed_correct', 'seed_total')} AS relative_improvement,
       {S.pct_string('(optimized_correct * seed_total - seed_correct * optimized_total)', '(seed_total * optimized_total)')} AS improvement,
       CASE WHEN optimized_correct * seed_total > seed_correct * optimized_total THEN 'IMPROVED'
            WHEN optimized_correct * seed_total < seed_correct * optimized_total THEN 'DEGRADED' ELSE 'NO_CHANGE' END AS verdict
FROM o"""
ORACLE_BODY["fewshot_flow"] = f"""WITH {CLAIMS}
SELECT claim_id, answer, claim_id % 3 = 0 AS valid, CASE WHEN claim_id % 3 = 0 THEN CAST(2 AS INTEGER) END AS n_items,
       CASE claim_id % 3 WHEN 0 THEN '[{{"input":"a","label":"SUPPORTED"}},{{"input":"b","label":"NOT_SUPPORTED"}}]'
            WHEN 1 THEN '{{"raw":"ERROR: Few-shot validation failed"}}' ELSE '{{"raw":"ERROR: Failed to parse model output as JSON"}}' END AS stored
FROM v_fmt"""
ORACLE_BODY["training_set_flow"] = f"""WITH {TRAIN},
last AS (SELECT input AS k, arg_max(reply, id) AS few_shot FROM v_fewshot_gaps GROUP BY input),
src AS (SELECT c.claim_id, {S.gold('c.label_raw')} AS answer, l.k IS NOT NULL AS attached, l.few_shot FROM v_claims c LEFT JOIN last l ON c.evidence = l.k),
v AS ({_fewshot_valid('few_shot')})
SELECT claim_id, answer, CASE WHEN claim_id IN (SELECT claim_id FROM v_train) THEN 'train' ELSE 'val' END AS split, attached,
       CASE WHEN valid THEN CAST(json_array_length(j) AS INTEGER) END AS n_items FROM v"""
ORACLE_BODY["claims_file_roundtrip"] = """
SELECT CAST(claim_id AS VARCHAR) AS id, md5(claim) AS claim_md5, md5(evidence) AS evidence_md5, label_raw AS label FROM v_claims"""
ORACLE_BODY["code_tasks_file_roundtrip"] = """
SELECT CAST(task_id AS VARCHAR) AS task_id, prompt, test, entry_point, CAST(NULL AS VARCHAR) AS canonical_solution FROM v_code_tasks"""
ORACLE_BODY["runs_roundtrip"] = """
SELECT run_id, CAST(variant AS INTEGER) AS candidate_id, CAST(correct AS BIGINT) / total AS score FROM v_run_metrics"""
ORACLE_BODY["prompts_roundtrip"] = """
SELECT 'run' || task_id AS run_dir, CASE WHEN task_id % 3 <> 0 THEN trim(prompt, chr(32) || chr(9) || chr(10) || chr(13)) ELSE 'config of run' || task_id END AS seed_prompt,
       trim(prompt || ' better', chr(32) || chr(9) || chr(10) || chr(13)) AS optimized_prompt FROM v_code_tasks"""
ORACLE_BODY["best_outputs_roundtrip"] = """
SELECT CAST(task_id AS INTEGER) AS task, CAST(sample_idx AS INTEGER) AS iteration, CAST(candidate_id AS INTEGER) AS program, CASE WHEN coalesce(passed, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(passed, false) DESC, candidate_id, sample_idx) AS rn FROM v_generations WHERE task_id IN (SELECT task_id FROM v_code_tasks)) WHERE rn = 1"""
ORACLE_BODY["metrics_log_roundtrip"] = """
SELECT name, count(*) AS n_points, max(step) AS last_step, min(value) AS least, max(value) AS greatest FROM v_metrics GROUP BY name"""
ORACLE_BODY["stream_windows_append"] = """
WITH e AS (SELECT run_name, epoch_us(ts) AS us, total_tokens FROM v_event_log),
m AS (SELECT (max(us) // 1000) * 1000 - 3600000000 AS mark FROM e),
t AS (SELECT 'tumbling' AS kind, run_name, (us // 3600000000) * 3600000000 AS window_start_us,
             (us // 3600000000) * 3600000000 + 3600000000 AS window_end_us, count(*) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS tokens
      FROM e GROUP BY ALL)
SELECT t.* FROM t, m WHERE window_end_us <= mark"""
_SHARED = "f' || CAST(t.task_id % 5 AS VARCHAR) || '"
ORACLE_BODY["code_evaluation_feedback"] = f"""
WITH g AS (SELECT t.task_id, k.candidate_id, s.range AS sample_idx, 'f' || CAST(t.task_id % 5 AS VARCHAR) AS entry_point, t.test, t.prompt,
                  CASE (t.task_id + 3 * k.candidate_id + s.range) % 4
                    WHEN 0 THEN '```python' || chr(10) || 'def {_SHARED}(x):' || chr(10) || '    return 1' || chr(10) || '```'
                    WHEN 1 THEN '```python' || chr(10) || 'def {_SHARED}(x):' || chr(10) || '    return 0' || chr(10) || '```'
                    WHEN 2 THEN 'def g(x): return 1'
                    ELSE '```' || chr(10) || 'py' || chr(10) || 'def {_SHARED}(x): return 1' || chr(10) || '```' END AS reply
           FROM v_code_tasks t CROSS JOIN v_candidates k CROSS JOIN range(1, 3) s),
{extract_cte("g", "task_id, candidate_id, sample_idx, entry_point, test, prompt", name="gc")},
c AS (SELECT *, CASE WHEN coalesce(test, '') = '' THEN 'NoTestCode' WHEN NOT contains(code, entry_point) THEN 'MissingFunction'
                     WHEN contains(code, 'return 1') THEN NULL ELSE 'AssertionError' END AS error_type FROM gc),
d AS (SELECT *, 'failed' AS exec_status,
             CASE error_type WHEN 'NoTestCode' THEN 'No test code provided for this problem'
                  WHEN 'MissingFunction' THEN 'Function ' || chr(39) || entry_point || chr(39) || ' not found in generated code' ELSE 'assert failed' END AS error_message
      FROM c WHERE error_type IS NOT NULL)
SELECT task_id, candidate_id, sample_idx, entry_point, exec_status AS execution_status, error_type, error_message, CAST(0.0 AS DOUBLE) AS score,
       concat_ws({NL}, 'FAILED: Task ' || {S.pystr('task_id')}, 'Function: `' || {S.pystr('entry_point')} || '`',
         'Execution Status: ' || exec_status, 'Error Type: ' || error_type, 'Error Message: ' || error_message,
         {NL} || 'Problem:' || {NL} || {S.preview(S.pystr('prompt'), 500)},
         {NL} || 'Generated Code:' || {NL} || '```python' || {NL} || {S.preview(S.pystr('code'), 800)} || {NL} || '```',
         {NL} || 'Guidance:' || {NL} || {guidance_sql('exec_status', 'error_type', False)}) AS feedback
FROM d"""
