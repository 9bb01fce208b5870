"""Checks of datasets: a table of rules, evaluated in one plan over the files, their names and the JSON files of many datasets.

A rule is a condition that its rows break: rows are files below a dataset's root, JSON files, or datasets, each with facts
that are worked out once. Rules can be added or left out by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import schema

DESCRIPTION = "dataset_description.json"


@dataclass(frozen=True)
class Rule:
    """code (fixed values of the standard's checks), severity (error or warning), message, rows (dataset, file or json), and the SQL condition of what breaks it."""

    code: str
    severity: str
    message: str
    rows: str
    broken: str
    path: str | None = None


#: Facts of datasets: has_description, parsed, name, version, has_readme, n_subjects; of files: path, file, valid, folder_subject,
#: folder_session, file_subject, file_session; of JSON files: path, parsed.
RULES = (
    Rule("MISSING_DATASET_DESCRIPTION", "error", "the dataset has no dataset_description.json", "dataset", "NOT has_description"),
    Rule("INVALID_DATASET_DESCRIPTION", "error", "the description is no JSON object", "dataset", "has_description AND NOT parsed", DESCRIPTION),
    Rule("MISSING_NAME", "error", "the description has no Name", "dataset", "parsed AND name = ''", DESCRIPTION),
    Rule("MISSING_BIDS_VERSION", "error", "the description names no version of the standard", "dataset", "parsed AND version = ''", DESCRIPTION),
    Rule("MISSING_README", "warning", "the dataset has no README", "dataset", "NOT has_readme"),
    Rule("NO_SUBJECTS", "error", "the dataset has no folder of a subject", "dataset", "n_subjects = 0"),
    Rule("INVALID_FILENAME", "warning", "the path fits none of the standard's patterns", "file", "folder_subject != '' AND NOT valid AND file NOT LIKE '.%' AND file NOT LIKE '%.json'"),
    Rule("SUBJECT_MISMATCH", "error", "the file names another subject than its folder", "file", "folder_subject != '' AND file_subject != '' AND file_subject != folder_subject"),
    Rule("SESSION_MISMATCH", "error", "the file names another session than its folder", "file", "folder_session != '' AND file_session != '' AND file_session != folder_session"),
    Rule("INVALID_JSON", "error", "the file is no JSON object", "json", f"NOT parsed AND path != '{DESCRIPTION}'"),
)


def _broken(rows: DataFrame, rules: list[Rule], path: Column) -> DataFrame:
    """dataset, severity, code, message, path: a row for each rule that a row breaks."""
    if not rules:
        return rows.select("dataset", *[F.lit(None).cast("string").alias(c) for c in ("severity", "code", "message", "path")]).where(F.lit(False))
    found = [
        F.when(F.expr(r.broken), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.code).alias("code"), F.lit(r.message).alias("message"), (F.lit(r.path).cast("string") if r.rows == "dataset" else path).alias("path")))
        for r in rules
    ]
    return rows.select("dataset", F.inline(F.array_compact(F.array(*found))))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def dataset_facts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row for each dataset of files (dataset, path below its root), with its description's fields from contents (dataset, path, text)."""
    flags = files.groupBy("dataset").agg(
        F.bool_or(F.col("path") == DESCRIPTION).alias("has_description"), F.bool_or(F.col("path").rlike(r"^README(\.(md|rst|txt))?$")).alias("has_readme"),
        F.countDistinct(F.when(F.col("path").rlike("^sub-[^/]+/"), F.substring_index("path", "/", 1))).alias("n_subjects"),
    )
    data = F.try_parse_json("text")
    get = lambda key: F.coalesce(F.trim(F.try_variant_get(data, f"$.{key}", "string")), F.lit(""))
    said = contents.where(F.col("path") == DESCRIPTION).select("dataset", _is_object(F.col("text")).alias("parsed"), get("Name").alias("name"), get("BIDSVersion").alias("version"))
    return flags.join(said, "dataset", "left").withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "has_description": F.col("has_description") | F.col("name").isNotNull()})


def file_facts(files: DataFrame) -> DataFrame:
    """Each file with its name, validity, and the subject and session of its folders and of its name ('' where there is none)."""
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return files.select(
        "dataset", "path", part("([^/]+)$").alias("file"), schema.is_valid(F.col("path")).alias("valid"), part("^sub-([^/]+)/").alias("folder_subject"), part("^sub-[^/]+/ses-([^/]+)/").alias("folder_session"),
        part("(?:^|/)sub-([^/_]+)[^/]*$").alias("file_subject"), part("_ses-([^/_]+)[^/]*$").alias("file_session"),
    )


def issues(files: DataFrame, contents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """dataset, severity, code, message, path of all that datasets break.

    files: dataset, path (below the root, without a leading slash); contents: dataset, path, text of their JSON files.
    """
    of = lambda rows: [r for r in rules if r.rows == rows]
    json = contents.select("dataset", "path", _is_object(F.col("text")).alias("parsed"))
    out = _broken(dataset_facts(files, contents), of("dataset"), F.lit(None))
    return out.unionByName(_broken(file_facts(files), of("file"), F.col("path"))).unionByName(_broken(json, of("json"), F.col("path")))


def counts(files: DataFrame, found: DataFrame) -> DataFrame:
    """dataset, errors, warnings and valid (no errors) of every dataset of files, also of those without any issue."""
    n = found.groupBy("dataset").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    every = files.select("dataset").distinct().join(n, "dataset", "left")
    return every.select("dataset", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("valid"))


def by_code(found: DataFrame) -> DataFrame:
    """severity, code, n, datasets of each rule that is broken."""
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"))
