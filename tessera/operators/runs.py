"""Runs, required files and diagnostics: decisions over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.paths import digits_after, last_part, pad_right

#: Run names offered where no run exists yet, and the files that a project needs, in order.
NO_RUNS = ("run", "experiment", "test")
REQUIRED = ("src/__init__.py", "config/__init__.py", "config/config.yaml", "scripts/train.py", "src/trainer.py", "src/utils.py", "config/settings.py")
#: Candidates by option.
CANDIDATES = {"--device": ["auto", "cpu", "mps", "cuda"], "--model": ["yolo11n.pt", "yolo11s.pt", "yolo11m.pt", "yolo11l.pt", "yolo11x.pt"], "--batch": ["-1", "8", "16", "32", "64"], "--epochs": ["10", "50", "100", "200", "300"], "--workers": ["0", "2", "4", "8"]}
SWITCHES = ("--config", "--epochs", "--batch", "--device", "--no-resume", "--model", "--run-name", "--workers", "--amp", "--no-amp", "--check-mps", "--optimize-for-mps", "--help")


def next_run_number(listing: DataFrame, prefix: str = "run", name_col: str = "name", dir_col: str | None = "is_dir") -> DataFrame:
    """One row (prefix, next_number): one more than the largest number that follows the prefix, 1 without any.

    Folders only; names whose rest isn't all ASCII digits are ignored; gaps aren't filled.
    """
    rows = listing.filter(F.col(dir_col)) if dir_col else listing
    return rows.agg((F.coalesce(F.max(digits_after(F.col(name_col), prefix)), F.lit(0).cast("bigint")) + 1).alias("next_number")).select(F.lit(prefix).alias("prefix"), "next_number")


def lifecycle(weights_exist: Column, resume: Column, documented: bool = False) -> Column:
    """skip, resume or scratch. As coded a run with weights is complete and always skipped; the documented variant
    resumes it where that is wanted."""
    return F.when(weights_exist & resume, "resume" if documented else "skip").when(weights_exist, "skip").otherwise("scratch")


def decide(runs: DataFrame, weights: DataFrame, run_col: str, weights_col: str, resume: Column, documented: bool = False) -> DataFrame:
    """runs with `decision`: weights are reduced to distinct keys before the join, which runs never multiply in."""
    w = weights.select(F.col(weights_col).alias("__run")).distinct()
    return runs.join(w, runs[run_col] == w["__run"], "left").withColumn("decision", lifecycle(F.col("__run").isNotNull(), resume, documented)).drop("__run")


def missing_required(required: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """The required rows that don't exist; they carry their ordinal, by which a report orders them."""
    return required.join(existing.select(key).distinct(), key, "left_anti")


def missing_count(required: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """One row (n_required, n_missing, passed): the outcome of a check of required files."""
    gone = existing.select(key).distinct().withColumn("__there", F.lit(True))
    n = F.count(F.when(F.col("__there").isNull(), True))
    return required.join(gone, key, "left").agg(F.count(F.lit(1)).alias("n_required"), n.alias("n_missing"), (n == 0).alias("passed"))


def path_problems(settings: DataFrame, existing: DataFrame) -> DataFrame:
    """(profile_name, ord, path, fatal, message) of the paths of settings that don't exist: the dataset first, then the
    folder of training data, both fatal, then the model, which is only warned of. `assert_paths` raises at the first."""
    one = lambda k, column, fatal, text: F.struct(F.lit(k).alias("ord"), F.col(column).alias("path"), F.lit(fatal).alias("fatal"), F.concat(F.lit(text), F.col(column)).alias("message"))
    wanted = F.array(one(0, "dataset_path", True, "dataset not found: "), one(1, "training_data_path", True, "training data not found: "), one(2, "model_path", False, "model not found: "))
    return settings.select("profile_name", F.explode(wanted).alias("w")).select("profile_name", "w.*").join(existing.select("path").distinct(), "path", "left_anti").select("profile_name", "ord", "path", "fatal", "message")


def assert_paths(required: DataFrame, existing: DataFrame, fatal: Column, key: str = "path", ord_col: str = "ord") -> DataFrame:
    """(ord, path, message) of missing files in order; raises at the first that is fatal."""
    gone = missing_required(required, existing, key).withColumn("message", F.concat(F.lit("missing: "), F.col(key)))
    first = gone.filter(fatal).orderBy(ord_col).limit(1).collect()
    if first:
        raise FileNotFoundError(first[0]["message"])
    return gone.select(ord_col, key, "message").orderBy(ord_col)


def complete_prefix(candidates: DataFrame, prefix: str, column: str = "candidate") -> DataFrame:
    return candidates.filter(F.col(column).startswith(prefix))


def complete_config(files: DataFrame, prefix: str, column: str = "name") -> DataFrame:
    """config/<name> of YAML files whose name begins with what follows the last slash of the prefix."""
    return files.filter(F.col(column).endswith(".yaml") & F.col(column).startswith(last_part(F.lit(prefix)))).select(F.concat(F.lit("config/"), column).alias("candidate"))


def complete_run(spark, listing: DataFrame | None, prefix: str) -> DataFrame:
    """Names of run folders with the prefix; where there is no folder of runs, the fixed names, unfiltered."""
    if listing is None:
        return spark.createDataFrame([(x,) for x in NO_RUNS], "candidate string")
    return listing.filter(F.col("is_dir") & F.col("name").startswith(prefix)).select(F.col("name").alias("candidate"))


def complete_option(spark, previous: str, current: str) -> DataFrame:
    """Candidates after an option, or the options themselves."""
    rows = CANDIDATES.get(previous, SWITCHES)
    return complete_prefix(spark.createDataFrame([(x,) for x in rows], "candidate string"), current)


def complete_typed(typed: DataFrame, previous: str = "previous", column: str = "typed") -> DataFrame:
    """complete_option() of every row: typed with `candidate`, a row for each that fits. What can follow is a literal of a
    few words for each option, filtered in place, so nothing is joined. A null `typed` has no candidate."""
    words = lambda rows: F.array(*[F.lit(x) for x in rows])
    follow = words(SWITCHES)
    for option, rows in CANDIDATES.items():
        follow = F.when(F.col(previous) == option, words(rows)).otherwise(follow)
    return typed.withColumn("candidate", F.explode(F.filter(follow, lambda x: F.startswith(x, F.col(column)))))


def complete_many(typed: DataFrame, candidates: DataFrame, most: int, column: str = "typed", candidate: str = "candidate") -> DataFrame:
    """(typed, rank, candidate): the first `most` distinct candidates, in UTF-8 order, of each distinct prefix that was typed.

    Candidates are entered under each of their beginnings of a length that was typed, and meet what was typed by equality.
    Of a beginning that very many share each task sends `most` rows. Nulls have no candidates; an empty prefix has the first
    of all.
    """
    wanted = typed.select(F.col(column).alias("typed")).dropna().distinct()
    words = candidates.select(F.col(candidate).alias("candidate")).dropna().distinct()
    longest = wanted.agg(F.max(F.length("typed"))).first()[0]
    beginnings = F.sequence(F.lit(0), F.least(F.length("candidate"), F.lit(-1 if longest is None else longest)))
    entered = words.filter(F.lit(longest is not None)).select("candidate", F.explode(beginnings).alias("n")).select(F.left("candidate", "n").alias("typed"), "candidate")
    first = Window.partitionBy("typed").orderBy("candidate")
    best = entered.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    return best.join(wanted, "typed", "left_semi").select("typed", F.col("rank").cast("bigint").alias("rank"), "candidate")


def periodic(epochs: DataFrame, every: int, column: str = "epoch") -> DataFrame:
    """Epochs at which the periodic hook acts, 0 among them. A period of 0 is an error."""
    if every == 0:
        raise ZeroDivisionError("the period is 0")
    return epochs.filter(F.col(column) % every == 0)


def prediction_source(img_folder: Column, source: Column, folder: Column) -> Column:
    """The image folder if asked for, else the source; an empty source counts as none and is an error."""
    own = F.when(F.coalesce(source, F.lit("")) != "", source)
    return F.coalesce(F.when(img_folder, folder), own, F.raise_error(F.lit("give a source or ask for the image folder")).cast("string"))


def check_script(texts: DataFrame, wanted: str, column: str = "value") -> DataFrame:
    """texts with n_chars (code points) and has_main; a text without it only warns, so readable is true."""
    return texts.withColumns({"n_chars": F.length(column).cast("bigint"), "has_main": F.col(column).contains(wanted), "readable": F.col(column).isNotNull()})


def summary(results: DataFrame) -> DataFrame:
    """(check, passed) -> with `line`, the check padded to 20 and its outcome; a null outcome (a crash) has failed."""
    ok = F.coalesce("passed", F.lit(False))
    return results.withColumns({"passed": ok, "line": F.concat(pad_right(F.col("check"), 20), F.lit(" "), F.when(ok, "PASSED").otherwise("FAILED"))})
