"""Sources and sinks: raw datasets, split / few-shot CSVs, prompts, run configs, detailed
results, best-output files, event and metric logs, reports.

Everything is read with an explicit schema (no inference) and written through
the DataFrame writer; file names carry no timestamps, partitions carry the keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.text import py_strip

# CSV dialect for texts with newlines, quotes and edge blanks: RFC 4180 quoting
# (quotes doubled), a NUL null marker so '' and null stay apart, no trimming.
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": '""',
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\u0000",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}

CLAIM_SCHEMA_STR = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("claim", T.StringType()),
    T.StructField("evidence", T.StringType()), T.StructField("label", T.StringType())])
CLAIM_SCHEMA_ARR = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("claim", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("label", T.StringType())])
CODE_TASK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                 ("task_id", "prompt", "canonical_solution", "test", "entry_point")])
SPLIT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                             ("task_id", "entry_point", "input", "answer", "test")])
FEWSHOT_SCHEMA = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(c, T.StringType()) for c in
                              ("input", "answer", "additional_context", "few_shot")])
FEWSHOT_ITEMS = "array<struct<input:string,label:string>>"

EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("run_name", T.StringType()), T.StructField("num_failures", T.LongType()),
        T.StructField("num_processed", T.LongType()), T.StructField("task_id", T.StringType()),
        T.StructField("entry_point", T.StringType()), T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()), T.StructField("reflector_output", T.StringType()),
        T.StructField("model_used", T.StringType()),
        T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()),
                                             T.StructField("completion_tokens", T.LongType()),
                                             T.StructField("total_tokens", T.LongType())]))])),
])
METRIC_SCHEMA = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("name", T.StringType()),
                              T.StructField("value", T.DoubleType()), T.StructField("step", T.LongType())])

# run configs: the nested (claims) and the flat (code) shape, read as one union schema
RUN_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("experiment_info", T.StructType([T.StructField("timestamp", T.StringType()),
                                                   T.StructField("run_directory", T.StringType())])),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("results", T.StructType([
        T.StructField("best_prompt_index", T.LongType()), T.StructField("best_prompt_score", T.DoubleType()),
        T.StructField("best_score", T.DoubleType()), T.StructField("best_idx", T.LongType()),
        T.StructField("seed_prompt_score", T.DoubleType()), T.StructField("improvement_over_seed", T.DoubleType()),
        T.StructField("pareto_front_score", T.DoubleType()), T.StructField("total_metric_calls", T.LongType()),
        T.StructField("num_candidates_evaluated", T.LongType()), T.StructField("num_candidates", T.LongType()),
        T.StructField("num_full_val_evals", T.LongType())])),
    T.StructField("all_candidate_scores", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("seed_prompt", T.StructType([T.StructField("system_prompt", T.StringType())])),
    T.StructField("best_candidate", T.StructType([T.StructField("system_prompt", T.StringType())])),
])


# ---------------------------------------------------------------- A1 / A2
def read_claims(spark: SparkSession, path: str, fmt: str = "json", split: str | None = None,
                evidence: str = "string") -> DataFrame:
    """Raw claims. ``path`` holds one folder per split; ``split`` (default: ``train`` if present,
    else the first in name order) is read. ``evidence`` picks the loader: ``string`` or ``array``."""
    base = path.rstrip("/")
    if split is None:
        # split folder names from a listing of the files under the path (content is never read);
        # a folder without split folders is read as it is
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base) \
            .select(F.regexp_extract(F.col("path"), r"([^/]+)/[^/]+$", 1).alias("split")).distinct()
        own = base.rsplit("/", 1)[-1]
        names = sorted(r["split"] for r in listing.collect() if r["split"] != own)
        split = "train" if "train" in names else (names[0] if names else None)
    target = f"{base}/{split}" if split else base
    schema = CLAIM_SCHEMA_ARR if evidence == "array" else CLAIM_SCHEMA_STR
    return spark.read.schema(schema).format(fmt).load(target)


def read_code_tasks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(CODE_TASK_SCHEMA).format(fmt).load(path)


# ---------------------------------------------------------------- A3 split CSV
def write_split(df: DataFrame, path: str, mode: str = "ignore") -> None:
    """Split CSV (task_id, entry_point, input, answer, test). ``mode='ignore'`` freezes a split:
    an existing one is never rewritten."""
    df.select(*[F.col(c).cast("string") for c in SPLIT_SCHEMA.names]).write.mode(mode).options(**CSV_WRITE).csv(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Read a split CSV back and rebuild the nested context."""
    d = spark.read.schema(SPLIT_SCHEMA).options(**CSV_READ).csv(path)
    return d.withColumn("additional_context", F.create_map(
        F.lit("task_id"), F.coalesce(F.col("task_id"), F.lit("")), F.lit("entry_point"),
        F.coalesce(F.col("entry_point"), F.lit("")), F.lit("test"), F.coalesce(F.col("test"), F.lit(""))))


def frozen_split(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """A split written once and reloaded afterwards: an existing split at ``path`` is never
    rewritten, so later runs (and other jobs) see exactly the same rows."""
    write_split(rows, path, mode="ignore")
    return read_split(spark, path)


def code_split_rows(tasks: DataFrame) -> DataFrame:
    """Code tasks in split-CSV shape (input = prompt, answer = canonical solution or '')."""
    def g(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in tasks.columns else F.lit("")
    return tasks.select(g("task_id").alias("task_id"), g("entry_point").alias("entry_point"),
                        g("prompt").alias("input"), g("canonical_solution").alias("answer"), g("test").alias("test"))


# ---------------------------------------------------------------- A4 few-shot CSV
def write_fewshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Few-shot CSV: id, input, answer, additional_context (JSON), few_shot (JSON)."""
    df.select("id", "input", "answer", "additional_context", "few_shot").write.mode(mode).options(**CSV_WRITE).csv(path)


def read_fewshot(spark: SparkSession, path: str) -> DataFrame:
    """Read a few-shot CSV: bad context JSON -> empty map; a few-shot that is not an item list
    is kept as raw text (``few_shot_raw``)."""
    d = spark.read.schema(FEWSHOT_SCHEMA).options(**CSV_READ).csv(path)
    v = F.try_parse_json(F.col("few_shot"))
    items = F.try_variant_get(v, "$", FEWSHOT_ITEMS)
    raw = F.coalesce(F.try_variant_get(v, "$.raw", "string"), F.col("few_shot"))
    ctx = F.from_json(F.col("additional_context"), "map<string,string>")
    return (d.withColumn("context", F.coalesce(ctx, F.create_map().cast("map<string,string>")))
             .withColumn("items", items)
             .withColumn("few_shot_raw", F.when(items.isNull(), raw)))


def write_files(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """One file per row, ``text`` at ``root``/``path``, written by the tasks and never half; the number of files.

    Rows are dealt out by their path, as small rows would come in few tasks. A path that repeats is
    written again: its rows should be alike.
    """
    from collections.abc import Iterator

    import pandas as pd

    from evalframe.operators.landing import file_system, write_whole

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = file_system(root)
        for pdf in it:
            for p, t in zip(pdf[path], pdf[text], strict=True):
                write_whole(store, f"{at.rstrip('/')}/{p}", lambda f, t=t: f.write((t or "").encode()))
            yield pd.DataFrame({"n": [len(pdf)]})
    return _spread(df.select(path, text), path).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Rows dealt out by ``column`` over all shuffle partitions, however few bytes they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def _as_uri(path: str) -> str:
    """``path`` escaped as in ``_metadata.file_path``."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def read_whole(spark: SparkSession, glob: str) -> DataFrame:
    """(value, file_path) of every file that ``glob`` matches, its whole text as ``value``.

    Small files come by the million, so the tasks list the folders, level by level, and read the files: the driver
    holds no list of them, and a task reads many. Only ``*`` and ``?`` are known here; other patterns,
    stores that pyarrow does not reach and globs without a match are left to Spark's reader.
    """
    import fnmatch
    from collections.abc import Iterator

    import pandas as pd
    import pyarrow as pa
    from pyarrow import fs

    from evalframe.operators.landing import file_system
    from evalframe.session import scratch_path

    def plain() -> DataFrame:
        return spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))

    parts = glob.split("/")
    first = next((i for i, p in enumerate(parts) if "*" in p or "?" in p), len(parts))
    base, patterns = "/".join(parts[:first]), [p for p in parts[first:] if p]
    if not patterns or not base or re.search(r"[\[\]{}\\]", glob):
        return plain()
    try:
        store, at = file_system(base)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return plain()
    except (pa.ArrowException, OSError, NotImplementedError):
        return plain()

    def entries(pattern: str, last: bool):
        def own(name: str) -> bool:
            return not name.startswith((".", "_"))

        def step(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, _ = file_system(base)
            for pdf in it:
                for folder in pdf["path"]:
                    found = []
                    for e in store.get_file_info(fs.FileSelector(folder)):
                        if not fnmatch.fnmatchcase(e.base_name, pattern):
                            continue
                        if not last:
                            found += [e.path] if e.type == fs.FileType.Directory else []
                        elif e.type == fs.FileType.Directory:  # a folder of part files
                            found += [x.path for x in store.get_file_info(fs.FileSelector(e.path, recursive=True)) if x.is_file and own(x.base_name)]
                        elif own(e.base_name):
                            found.append(e.path)
                    for i in range(0, len(found), 10_000):
                        yield pd.DataFrame({"path": found[i:i + 10_000]})
        return step

    paths = spark.createDataFrame([(at,)], "path string")
    for i, pattern in enumerate(patterns):
        paths = (_spread(paths, "path") if i else paths).mapInPandas(entries(pattern, i == len(patterns) - 1), "path string")
    # Listed once: what is read does not depend on how often it is.
    listed = scratch_path(spark, "listed")
    paths.write.parquet(listed)
    paths = spark.read.schema("path string").parquet(listed)
    if not paths.take(1):
        return plain()
    schema = pa.schema([("value", pa.binary()), ("file_path", pa.string())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(base)
        held, names, size = [], [], 0
        for b in it:
            for p in b.column(0).to_pylist():
                with store.open_input_stream(p) as f:
                    held.append(f.read())
                names.append(_as_uri(p))
                size += len(held[-1])
                if size >= 4 << 20 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(names)], schema=schema)
                    held, names, size = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(names)], schema=schema)
    return _spread(paths, "path").mapInArrow(read, "value binary, file_path string").select(F.col("value").cast("string").alias("value"), "file_path")


# ---------------------------------------------------------------- A5 prompts
def read_prompts(spark: SparkSession, runs_glob: str, runs: DataFrame | None = None,
                 name_pattern: str = r"([^/]+)_prompt\.txt$") -> DataFrame:
    """Prompt texts per run directory, stripped; the run folder and the prompt kind come from
    the path. A missing seed prompt falls back to the run config's ``seed_prompt.system_prompt``;
    a missing optimised prompt is an error."""
    t = read_whole(spark, runs_glob).select(py_strip(F.col("value")).alias("text"), "file_path")
    t = t.select(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("run_dir"),
                 F.regexp_extract("file_path", name_pattern, 1).alias("kind"), "text")
    wide = t.groupBy("run_dir").agg(F.max(F.when(F.col("kind") == "seed", F.col("text"))).alias("seed_prompt"),
                                    F.max(F.when(F.col("kind") == "optimized", F.col("text"))).alias("optimized_prompt"))
    if runs is not None:
        # a run with a config but no prompt file is there too, and raises below
        wide = wide.join(runs.select("run_dir", F.col("seed_prompt_text").alias("_cfg_seed")), "run_dir", "full") \
                   .withColumn("seed_prompt", F.coalesce(F.col("seed_prompt"), F.col("_cfg_seed"))).drop("_cfg_seed")
    return wide.withColumn("optimized_prompt", F.coalesce(
        F.col("optimized_prompt"),
        F.raise_error(F.concat(F.lit("optimized prompt missing for run "), F.col("run_dir"))).cast("string")))


# ---------------------------------------------------------------- A6 run configs
def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Run configs of both shapes as one table (one row per file)."""
    d = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").json(glob)
    r = F.col("results")
    return d.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_dir"),
        F.coalesce(F.col("experiment_info.timestamp"), F.col("timestamp")).alias("timestamp"),
        F.coalesce(r["best_prompt_index"], r["best_idx"]).alias("best_idx"),
        F.coalesce(r["best_prompt_score"], r["best_score"]).alias("best_score"),
        r["seed_prompt_score"].alias("seed_score"),
        r["pareto_front_score"].alias("frontier_score"),
        F.coalesce(r["num_candidates_evaluated"], r["num_candidates"]).alias("num_candidates"),
        r["total_metric_calls"].alias("total_metric_calls"),
        F.col("all_candidate_scores"),
        F.col("seed_prompt.system_prompt").alias("seed_prompt_text"),
        F.col("hyperparameters"))


def candidate_scores_of_runs(runs: DataFrame) -> DataFrame:
    """``all_candidate_scores`` exploded to (run_dir, candidate_id, score)."""
    e = runs.select("run_dir", F.explode("all_candidate_scores").alias("k", "score"))
    return e.select("run_dir", F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("candidate_id"), "score")


# ---------------------------------------------------------------- A7 detailed results
DETAILED_ITEM = "struct<task_id:string,entry_point:string,passed:boolean,score:double,error_type:string," \
                "error_message:string,extracted_code:string,full_response:string,predicted_label:string,status:string>"


def flatten_detailed(df: DataFrame, doc: str = "doc", item_type: str = DETAILED_ITEM) -> DataFrame:
    """A detailed-results document: an object whose list-valued keys are concatenated (the key is
    kept as ``prompt_type``), or a bare list (``prompt_type`` null). Other keys are ignored.

    The text is parsed once to VARIANT; typed extraction returns null for values
    that are not lists (an object is never read as a one-element list).
    """
    v = F.try_parse_json(F.col(doc))
    items = f"array<{item_type}>"
    keyed = df.select(F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("prompt_type", "_v"))
    keyed = keyed.select("prompt_type", F.explode(F.try_variant_get(F.col("_v"), "$", items)).alias("r"))
    bare = df.select(F.lit(None).cast("string").alias("prompt_type"), F.explode(F.try_variant_get(v, "$", items)).alias("r"))
    return keyed.unionByName(bare).select("prompt_type", "r.*")


def read_detailed(spark: SparkSession, glob: str, item_type: str = DETAILED_ITEM) -> DataFrame:
    d = spark.read.text(glob, wholetext=True).select(
        F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file_path"))
    return flatten_detailed(d, "doc", item_type)


# ---------------------------------------------------------------- comparison documents
_VARIANT_BLOCK = T.StructType([T.StructField(c, T.DoubleType()) for c in
                               ("accuracy", "pass_at_1", "pass_at_3", "pass_at_5", "delta_absolute", "delta_percent")]
                              + [T.StructField(c, T.LongType()) for c in
                                 ("correct", "passed", "total", "additional_correct", "additional_problems_solved")])
COMPARISON_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("test_size", T.LongType()),
    T.StructField("few_shot", T.StructType([T.StructField("injected", T.BooleanType()), T.StructField("file", T.StringType()),
                                            T.StructField("k", T.LongType())])),
    T.StructField("baseline", _VARIANT_BLOCK), T.StructField("optimized", _VARIANT_BLOCK),
    T.StructField("fewshot_optimized", _VARIANT_BLOCK)])


def read_comparisons(spark: SparkSession, glob: str) -> DataFrame:
    """Comparison documents of both shapes (accuracy or pass@k; optional few-shot block and
    optional pass@3/@5) as a long table: one row per (file, variant present)."""
    d = spark.read.schema(COMPARISON_SCHEMA).option("multiLine", "true").json(glob)
    d = d.withColumn("file_path", F.col("_metadata.file_path"))
    blocks = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("b"))
                       for v in ("baseline", "optimized", "fewshot_optimized")])
    e = d.select("file_path", "timestamp", "test_size", F.col("few_shot.injected").alias("few_shot_injected"),
                 F.explode(blocks).alias("x")).filter(F.col("x.b").isNotNull())
    b = F.col("x.b")
    return e.select(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("run_dir"), "timestamp", "test_size",
                    "few_shot_injected", F.col("x.variant").alias("variant"),
                    F.coalesce(b["accuracy"], b["pass_at_1"]).alias("score"), b["pass_at_3"].alias("pass_at_3"),
                    b["pass_at_5"].alias("pass_at_5"), F.coalesce(b["correct"], b["passed"]).alias("correct"),
                    b["total"].alias("total"), b["delta_absolute"].alias("delta_absolute"),
                    b["delta_percent"].alias("delta_percent"))


# ---------------------------------------------------------------- A8 best outputs
def read_best_outputs(spark: SparkSession, glob: str) -> DataFrame:
    """Best-output files: a bare float per file; task, iteration and program come from the path."""
    d = read_whole(spark, glob).select("value", F.col("file_path").alias("p"))
    pat = r"task_(\d+)/iter_(\d+)_prog_(\d+)\.json$"
    return d.select(F.regexp_extract("p", pat, 1).cast("int").alias("task"),
                    F.regexp_extract("p", pat, 2).cast("int").alias("iteration"),
                    F.regexp_extract("p", pat, 3).cast("int").alias("program"),
                    py_strip(F.col("value")).cast("double").alias("score"))


# ---------------------------------------------------------------- A9 / A10 logs
def append_events(df: DataFrame, path: str) -> None:
    """Append event rows (timestamp, event_type, data struct) to a JSONL log folder."""
    df.write.mode("append").json(path)


def reflection_events(parsed: DataFrame, summary: DataFrame, run_name: str, model: str | None = None) -> DataFrame:
    """Log rows (EVENT_SCHEMA) of one reflection batch: its start, an invocation per failure, its end.

    As in a log written while the batch runs, the run's name stands in the start and the end only;
    the folder or file name tells it for the invocations. Timestamps follow the failures' order.
    """
    data = {f.name: F.lit(None).cast(f.dataType) for f in EVENT_SCHEMA["data"].dataType}
    now = F.current_timestamp()

    def row(kind: str, order, **values):
        return F.struct(F.date_format(now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), order.cast("decimal(18,6)") / 1000000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                        F.lit(kind).alias("event_type"), F.struct(*[F.coalesce(values[k], c).alias(k) if k in values else c.alias(k) for k, c in data.items()]).alias("data")).alias("e")
    calls = parsed.select(row("reflector_invocation", F.col("failure_idx"), task_id=F.col("task_id").cast("string"), entry_point=F.col("entry_point"),
                              error_type=F.col("error_type"), error_message=F.col("error_message"), reflector_output=F.col("reflector_output"),
                              model_used=F.lit(model).cast("string")))
    n = F.col("failures_found")
    ends = summary.select(F.explode(F.array(row("batch_start", F.lit(0), run_name=F.lit(run_name), num_failures=n),
                                            row("batch_complete", n + 1, run_name=F.lit(run_name), num_processed=n))).alias("e"))
    return calls.unionByName(ends).select("e.*")


#: Run key of a log file: its name without the time of its start and the ending; of a log folder of
#: part files, the folder's name.
RUN_OF_FILE = r"([^/]+?)(?:_[0-9]{8}_[0-9]{6})?\.jsonl$"
RUN_OF_FOLDER = r"([^/]+)/part-[^/]+$"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log as a flat table; ``task_id`` is a string (logs hold both 29 and "Bench/29").

    Invocation lines do not name their run, so the run key of every line comes from its file
    (``run_file`` tells the file, one batch each where a run writes a new one each time).
    ``event_id`` orders the lines: by time, then by what opens and closes a batch, then by the line's own text; it is
    unique within a run for lines that differ.
    """
    d = spark.read.schema(EVENT_SCHEMA).json(path).withColumn("_f", F.col("_metadata.file_path"))
    base = F.regexp_extract("_f", RUN_OF_FILE, 1)
    run = F.when(base != "", base).otherwise(F.regexp_extract("_f", RUN_OF_FOLDER, 1))
    order = F.when(F.col("event_type") == "batch_start", "0").when(F.col("event_type") == "batch_complete", "2").otherwise("1")
    return d.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), "event_type",
                    F.coalesce(F.when(run != "", run), F.col("data.run_name")).alias("run_name"),
                    F.regexp_extract("_f", r"([^/]+)$", 1).alias("run_file"),
                    F.concat_ws("|", F.col("timestamp"), order, F.md5(F.to_json("data"))).alias("event_id"),
                    "data.num_failures", "data.num_processed", "data.task_id", "data.entry_point", "data.error_type",
                    "data.error_message", "data.reflector_output", "data.model_used",
                    F.col("data.usage.total_tokens").alias("total_tokens"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric points (timestamp, name, value, step)."""
    df.select("timestamp", "name", F.col("value").cast("double"), F.col("step").cast("long")).write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path).withColumn("ts", F.to_timestamp("timestamp"))


# ---------------------------------------------------------------- A11 reports
def write_report(df: DataFrame, path: str, partition_by: str = "run_id", mode: str = "overwrite") -> None:
    """Report / comparison / summary documents as JSON, one folder per run (no timestamps in names)."""
    df.write.mode(mode).partitionBy(partition_by).json(path)


def comparison_documents(compared: DataFrame, blocks: dict[str, str], run: str = "run_id", variant: str = "variant",
                         fewshot_file: str | None = None, fewshot_k: int | None = None) -> DataFrame:
    """Comparison document per run (COMPARISON_SCHEMA): test size, few-shot block, and a block of accuracy,
    counts and deltas per entry of ``blocks`` (document field -> variant); the baseline carries no deltas.
    A conditional aggregate over the run's rows: no list is collected."""
    def block(name: str):
        own = F.col(variant) == blocks[name]
        values = [F.col(c).cast("double").alias(c) if c == "accuracy" else F.col(c).cast("long").alias(c) for c in ("accuracy", "correct", "total")]
        if name != "baseline":
            values += [F.col("delta_absolute").alias("delta_absolute"), F.col("delta_percent").alias("delta_percent"),
                       F.col("additional_correct").cast("long").alias("additional_correct")]
        return F.max(F.when(own, F.struct(*values))).alias(name)
    injected = F.max(F.col(variant) == blocks["fewshot_optimized"]) if "fewshot_optimized" in blocks else F.lit(False)
    return compared.groupBy(run).agg(
        F.max(F.when(F.col(variant) == blocks["baseline"], F.col("total"))).cast("long").alias("test_size"),
        F.struct(injected.alias("injected"), F.lit(fewshot_file).cast("string").alias("file"), F.lit(fewshot_k).cast("long").alias("k")).alias("few_shot"),
        *[block(b) for b in blocks])


# ---------------------------------------------------------------- A12 synthetic claims
def _pick(seed, key: Column, salt, n: int) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(n))


def synthetic_claims(ids: DataFrame, id_col: str = "id", seed=0) -> DataFrame:
    """One synthetic claim row per input id: random words (claim 6-14, context 20-40 words),
    capitalised with a final '.', a random label. Seeded by md5 so any engine can redo it."""
    from evalframe.functions.constants import LABELS, SYNTHETIC_WORDS
    words = F.array(*[F.lit(w) for w in SYNTHETIC_WORDS])
    k = F.col(id_col)

    def sentence(tag: str, lo: int, hi: int) -> Column:
        n = _pick(seed, k, f"{tag}_n", hi - lo + 1) + lo
        ws = F.transform(F.sequence(F.lit(1), n.cast("int")),
                         lambda i: F.element_at(words, (_pick(seed, k, F.concat(F.lit(f"{tag}_"), i.cast("string")),
                                                              len(SYNTHETIC_WORDS)) + 1).cast("int")))
        s = F.array_join(ws, " ")
        return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30), F.lit("."))

    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (_pick(seed, k, "label", 2) + 1).cast("int"))
    return ids.select(k.alias("id"),
                      F.concat(F.lit("Claim: "), sentence("claim", 6, 14), F.lit("\nContext: "),
                               sentence("context", 20, 40)).alias("input"),
                      label.alias("answer"))
