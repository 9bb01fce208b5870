"""Readers and writers of the text formats: tab-separated tables, JSON sidecars, gradients, markers, head shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DESCRIPTION = (
    "Name string, BIDSVersion string, DatasetType string, License string, Authors array<string>, Acknowledgements string, HowToAcknowledge string, "
    "Funding array<string>, EthicsApprovals array<string>, ReferencesAndLinks array<string>, DatasetDOI string, HEDVersion string, "
    "GeneratedBy array<struct<Name: string, Version: string, Description: string, CodeURL: string>>, SourceDatasets array<struct<URL: string, DOI: string, Version: string>>"
)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Columns of trimmed text, n/a and empty cells null; gzip by the file's ending. With a schema there is no pass over the header."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "n/a").option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, row, line of text files, rows from 0 on in each file.

    A large file is read in blocks by many tasks: lines are numbered in their block, and blocks by the lines before them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = lines.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(before, F.lit(0)).alias("start"))
    within = lines.withColumn("k", F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1)
    return within.join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("k")).alias("row"), "line")


def read_headerless_tsv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Recordings without a header row, named by their sidecar's Columns, as numbers; row is the line's number in its file."""
    cells = numbered_lines(spark, path).withColumn("c", F.split(F.regexp_replace("line", "\r$", ""), "\t"))
    return cells.select("path", "row", *[F.get("c", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(columns)])


def write_tsv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """Tab-separated with a header, nulls as n/a. mode: error, ignore, overwrite or append."""
    df.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "n/a").option("quote", "\u0000").csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """path, onset, duration (0 where missing), trial_type and the other columns as a map; rows without an onset go."""
    df = read_tsv(spark, path)
    df = df.withColumn("path", F.input_file_name())
    known = {"onset", "duration", "trial_type", "path"}
    more = [c for c in df.columns if c not in known]
    extra = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if more else F.create_map().cast("map<string,string>")
    return df.select(
        "path", F.col("onset").try_cast("double").alias("onset"), F.coalesce((F.col("duration") if "duration" in df.columns else F.lit(None)).try_cast("double"), F.lit(0.0)).alias("duration"),
        (F.col("trial_type") if "trial_type" in df.columns else F.lit(None).cast("string")).alias("trial_type"), extra.alias("extra"),
    ).where("onset IS NOT NULL")


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """name, type (MISC where missing), units (n/a), status, sampling_frequency, low_cutoff, high_cutoff."""
    df = read_tsv(spark, path)
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(
        "name", channel_type(F.coalesce(get("type"), F.lit("MISC"))).alias("type"), F.coalesce(get("units"), F.lit("n/a")).alias("units"), get("status").alias("status"),
        *[get(c).try_cast("double").alias(c) for c in ("sampling_frequency", "low_cutoff", "high_cutoff")],
    )


# Channel types and their other spellings.
CHANNEL_TYPES = {
    "EEG": "EEG", "EOG": "EOG", "HEOG": "HEOG", "VEOG": "VEOG", "ECG": "ECG", "EKG": "ECG", "EMG": "EMG", "MISC": "MISC", "TRIG": "TRIG", "STIM": "TRIG",
    "REF": "REF", "SEEG": "SEEG", "ECOG": "ECOG", "DBS": "DBS", "RESP": "RESP", "TEMP": "TEMP", "GSR": "GSR", "PUPIL": "PUPIL", "AUDIO": "AUDIO",
}


def channel_type(name: Column) -> Column:
    """The standard spelling of a channel type; unknown ones are OTHER."""
    table = F.create_map(*[F.lit(x) for kv in CHANNEL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(name))), F.lit("OTHER"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """name and x, y, z as numbers, null where there are none: electrodes and optodes."""
    df = read_tsv(spark, path)
    return df.select("name", *[(F.col(c) if c in df.columns else F.lit(None)).try_cast("double").alias(c) for c in "xyz"])


def read_blood(spark: SparkSession, path: str) -> DataFrame:
    """time (0 where missing), plasma_radioactivity, whole_blood_radioactivity, metabolite_parent_fraction."""
    df = read_tsv(spark, path)
    get = lambda c: (F.col(c) if c in df.columns else F.lit(None)).try_cast("double")
    return df.select(F.coalesce(get("time"), F.lit(0.0)).alias("time"), *[get(c).alias(c) for c in ("plasma_radioactivity", "whole_blood_radioactivity", "metabolite_parent_fraction")])


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path and data (VARIANT) of JSON files; malformed ones have null data."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.try_parse_json("value").alias("data"))


def sidecar_tags(sidecars: DataFrame) -> DataFrame:
    """path, key, value (text) of each top-level entry that isn't null."""
    flat = sidecars.select("path", F.explode(F.from_json(F.to_json("data"), "map<string,string>")).alias("key", "value"))
    return flat.where("value IS NOT NULL")


def read_description(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's description with its types; is_derivative and pipeline follow from it."""
    df = spark.read.text(path, wholetext=True).select(F.from_json("value", DESCRIPTION).alias("d")).select("d.*")
    return df.withColumn("is_derivative", F.coalesce(F.lower("DatasetType") == "derivative", F.lit(False))).withColumn("pipeline", F.get(F.col("GeneratedBy"), F.lit(0)).Name)


def description_issues(descriptions: DataFrame) -> DataFrame:
    """field, message for each mandatory field of a description that is missing or empty, and for derivatives without a maker."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    issue = lambda name, text: F.struct(F.lit(name).alias("field"), F.lit(text).alias("message"))
    found = F.array(
        *[F.when(empty(F.col(c)), issue(c, f"{c} is missing")) for c in ("Name", "BIDSVersion")],
        F.when(F.col("is_derivative") & F.coalesce(F.size("GeneratedBy") < 1, F.lit(True)), issue("GeneratedBy", "a derivative names what made it")),
    )
    return descriptions.select(F.inline(F.array_compact(found)))


def gradients(bvals: Column, bvecs: Column) -> Column:
    """array<struct<b, x, y, z>> from the texts of a value file and a three-row vector file; raises if their lengths differ."""
    numbers = lambda line: F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = F.filter(F.split(bvecs, "\n"), lambda x: F.trim(x) != "")
    b, x, y, z = numbers(bvals), *[numbers(F.get(rows, F.lit(k))) for k in range(3)]
    zipped = F.transform(F.arrays_zip(b.alias("b"), x.alias("x"), y.alias("y"), z.alias("z")), lambda g: F.struct(g["b"].alias("b"), g["x"].alias("x"), g["y"].alias("y"), g["z"].alias("z")))
    fits = (F.size(rows) == 3) & (F.size(b) == F.size(x)) & (F.size(x) == F.size(y)) & (F.size(y) == F.size(z))
    return F.when(fits, zipped).otherwise(F.raise_error(F.lit("gradient values and vectors differ in length")))


def gradient_summary(table: Column) -> list[Column]:
    """n_volumes, n_b0, n_diffusion and unit_vectors of a gradient table."""
    b0 = lambda g: g.b <= 50
    length = lambda g: F.sqrt(g.x * g.x + g.y * g.y + g.z * g.z)
    return [
        F.size(table).alias("n_volumes"), F.size(F.filter(table, b0)).alias("n_b0"), F.size(F.filter(table, lambda g: ~b0(g))).alias("n_diffusion"),
        F.forall(table, lambda g: b0(g) | (F.abs(length(g) - 1) < 0.01)).alias("unit_vectors"),
    ]


def markers(lines: DataFrame, rate: float) -> DataFrame:
    """onset, duration, description from the marker lines `Mk1=Type,Description,Position,Size,Channel`."""
    f = F.split(F.regexp_extract("value", r"^Mk\d+=(.*)$", 1), ",")
    kind, text, size = F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(3)).try_cast("double")
    plain = kind.isin("Stimulus", "Response", "Comment")
    rows = lines.where(F.col("value").rlike(r"^Mk\d+="))
    return rows.select(
        ((F.get(f, F.lit(2)).try_cast("double") - 1) / rate).alias("onset"), F.when(size > 1, size / rate).otherwise(0.0).alias("duration"),
        F.when(plain & (text != ""), text).when(text == "", kind).otherwise(F.concat_ws("/", kind, text)).alias("description"),
    )


def head_shape(lines: DataFrame) -> DataFrame:
    """label, x, y, z, kind of the lines `label x y z` or `x y z`; comments go."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = lines.where(~F.col("value").rlike(r"^\s*([#%].*)?$")).select(parts.alias("p")).where("size(p) >= 3")
    label = F.when(F.size("p") >= 4, F.get("p", F.lit(0))).otherwise("")
    xyz = [F.get(F.col("p"), F.size("p") - 3 + k).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    low = F.lower("label")
    kind = F.when(low.rlike("nas|lpa|rpa|fid"), "fiducial").when(low.rlike("hpi|coil"), "hpi").when(low.rlike("eeg"), "eeg").otherwise("extra")
    return rows.select(label.alias("label"), *xyz).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("kind", kind)


def read_long(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, row, name, value of the cells of tab-separated tables, each with a header of its own; empty cells go.

    For the small tables of a dataset, whose columns differ from file to file; a file is read whole.
    """
    return _cells(spark.read.text(path, wholetext=True))


def _cells(texts: DataFrame) -> DataFrame:
    """path, row, name, value of the cells of whole files."""
    whole = texts.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    head = whole.select("path", F.split(F.get("lines", F.lit(0)), "\t").alias("names"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("row", "line")).where("line != ''")
    cells = head.select("path", "row", F.posexplode(F.split("line", "\t")).alias("k", "value"), "names")
    return cells.select("path", "row", F.trim(F.get("names", F.col("k"))).alias("name"), F.trim("value").alias("value")).where("name IS NOT NULL AND value NOT IN ('', 'n/a')")


# Tables of variables, by the end of their names: kind and level.
VARIABLES = {
    "participants.tsv": ("participants", "dataset"), "_sessions.tsv": ("sessions", "subject"), "_scans.tsv": ("scans", "session"), "_events.tsv": ("events", "run"),
    "_regressors.tsv": ("regressors", "run"), "_timeseries.tsv": ("regressors", "run"),
}


def load_variables(spark: SparkSession, root: str, *, kinds: list[str] | None = None, level: str | None = None) -> DataFrame:
    """kind, level, path, row, name, value of a dataset's tables of variables, of some kinds or of a level only.

    pivot() and sparse_to_dense() of tessera.operators.variables go on from here; recordings without a header
    (physio, stim) are read by read_headerless_tsv() with their sidecar's columns.
    """
    chosen = {e: kl for e, kl in VARIABLES.items() if (kinds is None or kl[0] in kinds) and level in (None, kl[1])}
    if not chosen:
        return spark.createDataFrame([], "kind string, level string, path string, row int, name string, value string")
    names = "{" + ",".join(f"*{e}" for e in chosen) + "}"
    cells = read_long_under(spark, root, names)
    kind, at = F, F
    for e, (k, lv) in chosen.items():
        fits = F.col("path").endswith(e)
        kind, at = kind.when(fits, k), at.when(fits, lv)
    return cells.select(kind.alias("kind"), at.alias("level"), "path", "row", "name", "value")


def read_long_under(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """read_long() of the files under root whose names fit a glob."""
    return _cells(spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern))


def read_asl_context(spark: SparkSession, path: str) -> DataFrame:
    """path, volume and its type (label, control, m0scan ...)."""
    return read_long(spark, path).where("name = 'volume_type'").select("path", F.col("row").alias("volume"), F.col("value").alias("volume_type"))


# Fields of coordinate-system files.
COORDSYSTEM = {
    "EEG": "EEGCoordinateSystem string, EEGCoordinateUnits string, EEGCoordinateSystemDescription string, FiducialsDescription string, FiducialsCoordinates map<string, array<double>>, "
    "FiducialsCoordinateSystem string, FiducialsCoordinateUnits string, AnatomicalLandmarkCoordinates map<string, array<double>>, IntendedFor string",
    "iEEG": "iEEGCoordinateSystem string, iEEGCoordinateUnits string, iEEGCoordinateSystemDescription string, iEEGCoordinateProcessingDescription string, iEEGCoordinateProcessingReference string, IntendedFor string",
}


def read_coordsystem(spark: SparkSession, path: str, kind: str = "EEG") -> DataFrame:
    """path and the typed fields of coordinate-system files of EEG or iEEG."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.from_json("value", COORDSYSTEM[kind]).alias("d"))
    return df.select("path", "d.*")


def read_genetic_info(spark: SparkSession, path: str) -> DataFrame:
    """dataset (a link), databases and the descriptors of a dataset's genetic_info.json."""
    d = F.from_json("value", "Dataset string, Database string, Descriptors string, GeneticLevel string, AnalyticalApproach string, SampleOrigin string, TissueOrigin string")
    return spark.read.text(path, wholetext=True).select(d.alias("d")).select("d.*")


def write_manifest(df: DataFrame, path: str, *, mode: str = "error", form: str = "csv") -> None:
    """A manifest as CSV with a header, values with commas or quotes quoted, or as Parquet (without run and extension).

    A filtered manifest is written as it streams.
    """
    if form == "parquet":
        df.drop("run", "extension").write.mode(mode).parquet(path)
        return
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
