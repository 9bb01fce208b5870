"""Queries of the catalog and its associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths
from tessera.operators import associations, catalog, store
from tessera.plans import views
from tessera.sources import files as listings

_WIDE = ", ".join(f"nullif(regexp_extract(path, '{p}', 1), '') AS \"{n}\"" for n, p in config.ENTITIES)
WIDE_SQL = f"{views.FILES_SQL}, w AS (SELECT path, {_WIDE} FROM f)"
_UNPIVOT = " UNION ALL ".join(f"SELECT path, '{n}' AS entity, \"{n}\" AS value FROM w WHERE \"{n}\" IS NOT NULL" for n, _ in config.ENTITIES)
TAGS_SQL = f"{WIDE_SQL}, t AS ({_UNPIVOT})"
_KEYS = ["subject", "session", "task", "run"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d)


def _query(spark: SparkSession, d: str) -> catalog.CatalogQuery:
    return catalog.CatalogQuery.of_paths(_files(spark, d))


def entity_parse(spark: SparkSession, d: str) -> DataFrame:
    return catalog.wide(_files(spark, d)).select("path", *_KEYS, "datatype", "suffix", "extension")


def catalog_tags(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tags(_files(spark, d))


def file_attributes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.files(_files(spark, d))


def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).suffix("bold").any("run").task("F").none("echo").paths()


def stored_filter(spark: SparkSession, d: str) -> DataFrame:
    path = listings.scratch(spark, "index")
    store.save(_files(spark, d), path)
    return store.load(spark, path).suffix("bold").any("run").task("F").none("echo").paths()


def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).one_of("suffix", "eeg", "meg").one_of("session", "1995", "1996").paths()


def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).regex("subject", "^000[0-4]").extension("edf").paths()


def filter_any_none(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).any("task").none("acquisition").equals_int("run", 3).paths()


def unique_values(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).datatype("func").unique("session")


def directories(spark: SparkSession, d: str) -> DataFrame:
    return _query(spark, d).suffix("dwi").directories("run")


def entity_names(spark: SparkSession, d: str) -> DataFrame:
    return catalog.entity_counts(catalog.tags(_files(spark, d)))


def collected(spark: SparkSession, d: str) -> DataFrame:
    m = _query(spark, d).suffix("meg").collect_maps()
    return m.select("path", F.array_join(F.transform(F.array_sort(F.map_entries("entities")), lambda x: F.concat_ws("=", x.key, x.value)), ";").alias("entities"))


def scope_union(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    derived = f.where(F.col("path").contains("/func/")).select(F.regexp_replace("path", "^/ds/", "/ds/derivatives/prep/").alias("path"), F.lit("prep").alias("pipeline"))
    both = f.withColumn("pipeline", F.lit(None).cast("string")).unionByName(derived).dropDuplicates(["path"])
    return catalog.CatalogQuery(both, catalog.tags(both.select("path"))).scope("derivatives").task("O").paths()


def natural_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    p = views.read(spark, d, "part").select("p_partkey", F.concat_ws("_", "p_brand", F.col("p_size").cast("string"), "p_name").alias("name"), "p_brand")
    order = Window.partitionBy("p_brand").orderBy(paths.natural_key(F.col("name")), "p_partkey")
    return p.select("p_partkey", paths.natural_key(F.col("name")).alias("sort_key"), F.row_number().over(order).alias("rank"))


def close_matches(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("GERMNY",), ("UNITED STATE",), ("CHNA",)], "word string")
    return catalog.close_matches(words, views.read(spark, d, "nation").select(F.col("n_name").alias("candidate")), 3).select("word", "candidate", "distance", "rank")


def path_build(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.wide(_files(spark, d)).where("suffix = 'bold'")
    pattern = "sub-{subject}[/ses-{session}]/{datatype<func|meg>|func}/sub-{subject}[_ses-{session}]_task-{task}[_acq-{acquisition}][_run-{run}]_{suffix<bold|cbv>}{extension<.nii|.nii.gz>|.nii.gz}"
    return w.select("path", paths.build_path({n: F.col(n) for n, _ in config.ENTITIES}, pattern).alias("built"))


def associated_groups(spark: SparkSession, d: str) -> DataFrame:
    return catalog.associated_groups(_files(spark, d))


def _sidecars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files with their entities, and sidecars of four depths: the root, subjects (two kinds), sessions."""
    w = catalog.wide(_files(spark, d)).select("path", "suffix", "subject", "session", "task", "run")
    null = F.lit(None).cast("string")
    cols = lambda path, dir_, key, value, subject=null, task=null: [path.alias("path"), dir_.alias("dir"), F.col("suffix"), key.alias("key"), value.alias("value"), subject.alias("subject"), null.alias("session"), task.alias("task"), null.alias("run")]
    root = w.select("suffix").distinct().select(*cols(F.concat(F.lit("/ds/"), F.col("suffix"), F.lit(".json")), F.lit("/ds"), F.lit("PowerLineFrequency"), F.lit("50")))
    task = w.select("suffix", "task").distinct().select(*cols(F.concat(F.lit("/ds/task-"), F.col("task"), F.lit("_"), F.col("suffix"), F.lit(".json")), F.lit("/ds"), F.lit("TaskName"), F.lower("task"), null, F.col("task")))
    sub_dir = F.concat(F.lit("/ds/sub-"), F.col("subject"))
    sub = w.where("CAST(subject AS INT) % 3 = 0").select("suffix", "subject").distinct()
    sub = sub.select(*cols(F.concat(sub_dir, F.lit("/sub-"), F.col("subject"), F.lit("_"), F.col("suffix"), F.lit(".json")), sub_dir, F.lit("PowerLineFrequency"), F.lit("60"), F.col("subject")))
    return w, root.unionByName(task).unionByName(sub)


_SIDECARS_SQL = f"""{WIDE_SQL},
sc AS (
  SELECT DISTINCT '/ds/' || suffix || '.json' AS path, '/ds' AS dir, suffix, 'PowerLineFrequency' AS key, '50' AS value, NULL AS subject, NULL AS task FROM w
  UNION SELECT DISTINCT '/ds/task-' || task || '_' || suffix || '.json', '/ds', suffix, 'TaskName', lower(task), NULL, task FROM w
  UNION SELECT DISTINCT '/ds/sub-' || subject || '/sub-' || subject || '_' || suffix || '.json', '/ds/sub-' || subject, suffix, 'PowerLineFrequency', '60', subject, NULL FROM w WHERE subject::INT % 3 = 0)"""


def metadata_inherit(spark: SparkSession, d: str) -> DataFrame:
    files, sidecars = _sidecars(spark, d)
    return associations.inherited(files, sidecars, entities=_KEYS)


def metadata_inherit_strict(spark: SparkSession, d: str) -> DataFrame:
    files, sidecars = _sidecars(spark, d)
    return associations.inherited(files, sidecars, entities=_KEYS, strict=True)


def assoc_edges(spark: SparkSession, d: str) -> DataFrame:
    files, sidecars = _sidecars(spark, d)
    return associations.metadata_edges(files, sidecars, entities=_KEYS).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))


def intended_for(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.wide(_files(spark, d)).where("suffix = 'dwi'")
    bold = F.replace(F.replace("path", F.lit("/dwi/"), F.lit("/func/")), F.lit("_dwi."), F.lit("_bold."))
    eeg = F.replace(F.replace("path", F.lit("/dwi/"), F.lit("/eeg/")), F.lit("_dwi.nii.gz"), F.lit("_eeg.edf"))
    intended = F.array(F.regexp_replace(bold, "^/ds/", "bids::"), F.regexp_replace(eeg, "^/ds/sub-[^/]*/", ""), F.lit("bids:other:x.nii"))
    return associations.intended_for(w.select("path", "subject", intended.alias("intended")), "/ds")


def companions(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.wide(_files(spark, d)).select("path", "suffix", *_KEYS)
    return associations.companions(w.where("suffix = 'eeg'").withColumn("run", F.lit(None).cast("string")), w.where("suffix = 'meg'"), keys=_KEYS)


def nearest_file(spark: SparkSession, d: str) -> DataFrame:
    w = catalog.wide(_files(spark, d)).select("path", "suffix", *_KEYS)
    extra = w.where("suffix = 'meg'").select(F.regexp_replace("path", "/ses-[^/]*/meg/", "/").alias("path"), "suffix", *_KEYS)
    return associations.nearest(w.where("suffix = 'eeg'"), w.where("suffix = 'meg'").unionByName(extra).distinct(), entities=_KEYS)


def fieldmap_theta(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    maps = f.where(F.col("path").endswith("_bold.nii.gz")).select(F.regexp_replace("path", "_bold.nii.gz$", "_fieldmap.nii.gz").alias("path"), F.regexp_extract("path", "^/ds/sub-[^/]*/(.*)$", 1).alias("target"))
    return associations.field_maps(f, maps)


def group_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    c = views.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return associations.expand_missing(c, "segment")


def valid_paths(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    p = F.col("path")
    return f.groupBy(paths.is_valid(p, "/ds").alias("valid"), p.rlike(paths.glob_pattern("*_run-0?_bold*")).alias("by_glob"), paths.matches_any(p, [r"/meg/", r"_task-P_"]).alias("ignored")).agg(F.count("*").alias("n"))


def companion_paths(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(F.col("path").endswith(".edf")).select("path", paths.companion(F.col("path"), "channels", "tsv").alias("channels"))


QUERIES = {f.__name__: f for f in (
    entity_parse, catalog_tags, file_attributes, catalog_filter, stored_filter, filter_in, filter_regex, filter_any_none, unique_values, directories, entity_names, collected,
    scope_union, natural_sort_rank, close_matches, path_build, associated_groups, metadata_inherit, metadata_inherit_strict, assoc_edges, intended_for,
    companions, nearest_file, fieldmap_theta, group_missing_keys, valid_paths, companion_paths,
)}

_FITS = " AND ".join(f"(sc.{k} IS NULL OR w.{k} IS NULL OR sc.{k} = w.{k})" for k in ("subject", "task"))
_FITS_STRICT = " AND ".join(f"(sc.{k} IS NULL OR sc.{k} = w.{k})" for k in ("subject", "task"))
_INHERIT = """
SELECT path, key, value, origin FROM (
  SELECT w.path, sc.key, sc.value, sc.path AS origin,
    row_number() OVER (PARTITION BY w.path, sc.key ORDER BY length(sc.dir) DESC, (sc.subject IS NOT NULL)::INT + (sc.task IS NOT NULL)::INT DESC, sc.path DESC) AS r
  FROM w JOIN sc ON w.suffix = sc.suffix AND starts_with(w.path, sc.dir || '/') AND {fits}) WHERE r = 1"""

ORACLES = {
    "entity_parse": f"WITH {WIDE_SQL} SELECT path, subject, session, task, run, datatype, suffix, extension FROM w",
    "catalog_tags": f"WITH {TAGS_SQL} SELECT path, entity, value FROM t",
    "file_attributes": f"""WITH {views.FILES_SQL} SELECT path, regexp_extract(path, '[^/]*$') AS filename, regexp_replace(path, '/[^/]*$', '') AS dirname,
      CASE WHEN path LIKE '%.nii.gz' THEN 'image' WHEN path LIKE '%.edf' THEN 'eeg' WHEN path LIKE '%.fif' THEN 'meg' ELSE 'generic' END AS file_type,
      CASE WHEN path LIKE '%.nii.gz' THEN '.nii.gz' ELSE regexp_extract(path, '\\.[^.]*$') END AS ext, regexp_extract(path, '_([^_.]*)\\.[^/]*$', 1) AS stem_suffix FROM f""",
    "catalog_filter": f"WITH {WIDE_SQL} SELECT path FROM w WHERE suffix = 'bold' AND run IS NOT NULL AND task = 'F' AND echo IS NULL",
    "stored_filter": f"WITH {WIDE_SQL} SELECT path FROM w WHERE suffix = 'bold' AND run IS NOT NULL AND task = 'F' AND echo IS NULL",
    "filter_in": f"WITH {WIDE_SQL} SELECT path FROM w WHERE suffix IN ('eeg', 'meg') AND session IN ('1995', '1996')",
    "filter_regex": f"WITH {WIDE_SQL} SELECT path FROM w WHERE regexp_matches(subject, '^000[0-4]') AND extension = '.edf'",
    "filter_any_none": f"WITH {WIDE_SQL} SELECT path FROM w WHERE task IS NOT NULL AND acquisition IS NULL AND run::INT = 3",
    "unique_values": f"WITH {WIDE_SQL} SELECT DISTINCT session AS value FROM w WHERE datatype = 'func'",
    "directories": f"WITH {WIDE_SQL} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS directory FROM w WHERE suffix = 'dwi' AND run IS NOT NULL",
    "entity_names": f"WITH {TAGS_SQL} SELECT entity, count(*) AS n_tags, count(DISTINCT value) AS n_values FROM t GROUP BY entity",
    "collected": f"WITH {TAGS_SQL} SELECT path, string_agg(entity || '=' || value, ';' ORDER BY entity) AS entities FROM t WHERE path IN (SELECT path FROM w WHERE suffix = 'meg') GROUP BY path",
    "scope_union": f"WITH {WIDE_SQL} SELECT '/ds/derivatives/prep/' || substr(path, 5) AS path, 'prep' AS pipeline FROM w WHERE path LIKE '%/func/%' AND task = 'O'",
    "natural_sort_rank": """
WITH p AS (SELECT p_partkey, p_brand, lower(p_brand || '_' || p_size || '_' || p_name) AS name FROM part),
k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(name, '(\\d+|\\D+)', 1), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(coalesce(nullif(ltrim(r, '0'), ''), '0'), 20, '0') ELSE r END), '') AS sort_key FROM p)
SELECT p_partkey, sort_key, (row_number() OVER (PARTITION BY p_brand ORDER BY sort_key, p_partkey))::INT AS rank FROM k""",
    "close_matches": """
WITH w(word) AS (VALUES ('GERMNY'), ('UNITED STATE'), ('CHNA')),
d AS (SELECT word, n_name AS candidate, levenshtein(lower(word), lower(n_name))::INT AS distance FROM nation, w)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY word ORDER BY distance, candidate))::INT AS rank FROM d WHERE distance <= greatest(length(word), 3)) WHERE rank <= 3""",
    "path_build": f"""WITH {WIDE_SQL} SELECT path, 'sub-' || subject || coalesce('/ses-' || session, '') || '/func/sub-' || subject || coalesce('_ses-' || session, '') || '_task-' || task
      || coalesce('_run-' || run, '') || '_bold.nii.gz' AS built FROM w WHERE suffix = 'bold'""",
    "associated_groups": f"""WITH {TAGS_SQL} SELECT path, coalesce(string_agg(CASE WHEN entity NOT IN ('echo', 'part', 'ch', 'direction', 'suffix') THEN entity || '=' || value END, '|' ORDER BY entity || '=' || value), '') AS "group" FROM t GROUP BY path""",
    "metadata_inherit": f"WITH {_SIDECARS_SQL} " + _INHERIT.format(fits=_FITS),
    "metadata_inherit_strict": f"WITH {_SIDECARS_SQL} " + _INHERIT.format(fits=_FITS_STRICT),
    "assoc_edges": f"""WITH {_SIDECARS_SQL},
j AS (SELECT DISTINCT w.path, sc.path AS origin, length(sc.dir) AS depth FROM w JOIN sc ON w.suffix = sc.suffix AND starts_with(w.path, sc.dir || '/') AND {_FITS}),
c AS (SELECT DISTINCT above, origin FROM (SELECT *, lag(origin) OVER (PARTITION BY path ORDER BY depth, origin) AS above FROM j) WHERE above IS NOT NULL),
e AS (SELECT origin AS src, path AS dst, 'Metadata' AS kind FROM j UNION SELECT origin, above, 'Child' FROM c UNION SELECT above, origin, 'Parent' FROM c)
SELECT kind, count(*) AS n, count(DISTINCT src) AS n_src FROM e GROUP BY kind""",
    "intended_for": f"""WITH {WIDE_SQL}, x AS (SELECT path, unnest([replace(replace(path, '/dwi/', '/func/'), '_dwi.', '_bold.'), replace(replace(path, '/dwi/', '/eeg/'), '_dwi.nii.gz', '_eeg.edf')]) AS other FROM w WHERE suffix = 'dwi')
      SELECT path AS src, other AS dst, 'IntendedFor' AS kind FROM x UNION ALL SELECT other, path, 'InformedBy' FROM x""",
    "companions": f"WITH {WIDE_SQL} SELECT a.path AS src, b.path AS dst FROM w a JOIN w b ON a.suffix = 'eeg' AND b.suffix = 'meg' AND a.subject = b.subject AND a.session = b.session AND a.task = b.task",
    "nearest_file": f"""WITH {WIDE_SQL},
c AS (SELECT path AS candidate, regexp_replace(path, '/[^/]*$', '') AS dir, subject, session, task, run FROM (SELECT path, subject, session, task, run FROM w WHERE suffix = 'meg'
  UNION SELECT regexp_replace(path, '/ses-[^/]*/meg/', '/'), subject, session, task, run FROM w WHERE suffix = 'meg'))
SELECT path, candidate AS nearest FROM (
  SELECT w.path, candidate, row_number() OVER (PARTITION BY w.path ORDER BY length(dir) DESC,
    coalesce((w.subject = c.subject)::INT, 0) + coalesce((w.session = c.session)::INT, 0) + coalesce((w.task = c.task)::INT, 0) + coalesce((w.run = c.run)::INT, 0) DESC, candidate) AS r
  FROM w JOIN c ON w.suffix = 'eeg' AND starts_with(w.path, c.dir || '/')) WHERE r = 1""",
    "fieldmap_theta": f"""WITH {views.FILES_SQL} SELECT DISTINCT f.path, regexp_replace(m.path, '_bold.nii.gz$', '_fieldmap.nii.gz') AS fieldmap
      FROM f JOIN f m ON ends_with(m.path, '_bold.nii.gz') AND ends_with(f.path, '/' || regexp_extract(m.path, '^/ds/sub-[^/]*/(.*)$', 1))""",
    "group_missing_keys": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer)
      SELECT c_custkey, segment FROM c WHERE segment IS NOT NULL UNION ALL SELECT c_custkey, v.segment FROM c, (SELECT DISTINCT segment FROM c WHERE segment IS NOT NULL) v WHERE c.segment IS NULL""",
    "valid_paths": f"""WITH {views.FILES_SQL} SELECT regexp_matches(path, '^/ds/sub-[a-zA-Z0-9+]+/') AS valid, regexp_matches(path, '/[^/]*_run-0[^/]_bold[^/]*$') AS by_glob,
      regexp_matches(path, '/meg/|_task-P_') AS ignored, count(*) AS n FROM f GROUP BY ALL""",
    "companion_paths": f"WITH {views.FILES_SQL} SELECT path, regexp_replace(path, '_eeg\\.edf$', '_channels.tsv') AS channels FROM f WHERE path LIKE '%.edf'",
}
