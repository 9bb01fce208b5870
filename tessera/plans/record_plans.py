"""Queries of typed metadata, validity, lookups, recordings and preprocessing steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import metadata, schema
from tessera.operators import catalog, recordings, signal, steps, variables
from tessera.plans import views
from tessera.plans.catalog_plans import _KEYS, WIDE_SQL
from tessera.plans.signal_plans import _r, _rounded
from tessera.plans.views import EVENTS_SQL, FILES_SQL, SIGNAL_SQL


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return catalog.wide(views.files(spark, d))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    p = views.read(spark, d, "part")
    lists = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[1, 2.5, "), F.col("p_size").cast("string"), F.lit("]"))).otherwise(F.col("p_size").cast("string"))
    text = F.concat(
        F.lit('{"SliceCount": '), F.col("p_size").cast("string"), F.lit(', "Manufacturer": "'), "p_brand", F.lit('", "IsSquare": '), (F.col("p_size") % 2 == 0).cast("string"),
        F.when(F.col("p_size") % 3 != 0, F.lit(', "RepetitionTime": 2.5')).otherwise(""), F.lit(', "Nested": [{"EchoTime": '), lists, F.lit("}]}"),
    )
    return p.select("p_partkey", text.alias("data"), F.concat(F.lit('{"EchoTime": '), lists, F.lit("}")).alias("echo"))


def typed_metadata(spark: SparkSession, d: str) -> DataFrame:
    get = lambda key, kind: metadata.field(F.col("data"), key, kind)
    odd = F.when(F.col("p_partkey") % 11 == 0, F.substring("data", 1, 20)).when(F.col("p_partkey") % 11 == 1, '{"SliceCount": "7", "Manufacturer": 5, "IsSquare": "true", "RepetitionTime": "2", "Nested": {}}')
    odd = odd.when(F.col("p_partkey") % 11 == 2, '{"SliceCount": 2.5, "IsSquare": null, "RepetitionTime": 3, "Nested": []}').when(F.col("p_partkey") % 11 == 3, "[1]")
    return _parts(spark, d).withColumn("data", odd.otherwise(F.col("data"))).select(
        "p_partkey", get("RepetitionTime", "number").alias("tr"), get("SliceCount", "whole").alias("slices"), get("Manufacturer", "text").alias("maker"), get("IsSquare", "flag").alias("square"),
        get("Manufacturer", "number").alias("wrong_kind"), F.size(get("Nested", "list")).alias("n_nested"), metadata.total(F.col("data"), ["SliceCount", "NoSuchCount"]).alias("total"),
    )


def metadata_struct(spark: SparkSession, d: str) -> DataFrame:
    s = metadata.as_struct(F.col("data"), "SliceCount bigint, Manufacturer string, RepetitionTime double", ["SliceCount", "RepetitionTime"])
    return _parts(spark, d).select("p_partkey", s.alias("s")).select("p_partkey", "s.SliceCount", "s.RepetitionTime", "s.Manufacturer")


def echo_lists(spark: SparkSession, d: str) -> DataFrame:
    x = metadata.numbers(F.col("echo"), "EchoTime")
    return _parts(spark, d).select("p_partkey", F.size(x).alias("n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("total"))


def snake_keys(spark: SparkSession, d: str) -> DataFrame:
    data = F.concat(F.lit('{"RepetitionTime":'), F.col("p_size").cast("string"), F.lit(',"Nested":[{"MRTransmitCoil":"'), "p_brand", F.lit('"}]}'))
    return views.read(spark, d, "part").select("p_partkey", metadata.snake_keys(data).alias("data"))


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    run = metadata.padded(F.col("run"))
    return _wide(spark, d).select(
        "path", run.value.alias("run"), run.formatted.alias("run_text"), metadata.coerced(F.col("session"), "number").alias("session"), metadata.coerced(F.col("task"), "whole").alias("task_number"),
        metadata.coerced(F.col("task"), "flag").alias("task_flag"),
    )


def schema_validity(spark: SparkSession, d: str) -> DataFrame:
    p = F.substring(F.col("path"), 5, 1 << 20)
    moved = F.when(F.col("session") == "1996", F.replace(p, F.lit("/ses-1996/"), F.lit("/sess/"))).when(F.col("session") == "1995", F.concat(F.lit("/"), p)).when(F.col("session") == "1994", F.concat(F.split_part(p, F.lit("/"), F.lit(1)), F.lit("/ses-1994/"), F.split_part(p, F.lit("/"), F.lit(1)), F.lit("_ses-1994_scans.tsv"))).otherwise(p)
    return _wide(spark, d).select("path", schema.is_valid(moved).alias("valid"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    w = _wide(spark, d)
    return w.groupBy(schema.is_datatype(F.col("datatype")).alias("datatype"), schema.is_suffix(F.col("suffix")).alias("suffix"), schema.is_extension(F.col("extension")).alias("extension"), schema.is_suffix(F.col("task")).alias("task")).agg(F.count("*").alias("n"))


def repetition_time(spark: SparkSession, d: str) -> DataFrame:
    m = _wide(spark, d).where("suffix = 'bold'").select("path", F.lit("RepetitionTime").alias("key"), F.concat(F.lit("2.50000"), F.col("run")).alias("value"))
    return metadata.repetition_time(m)


def file_count(spark: SparkSession, d: str) -> DataFrame:
    return catalog.CatalogQuery.of_paths(views.files(spark, d)).task("O").checked().count()


def modality_files(spark: SparkSession, d: str) -> DataFrame:
    return recordings.modality_files(catalog.CatalogQuery.of_paths(views.files(spark, d)), "meg").paths()


def _gradients(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = _wide(spark, d).where("suffix = 'dwi'").select("path", "suffix", "extension", "acquisition", *_KEYS)
    tables = [w.withColumn("path", F.replace("path", F.lit(".nii.gz"), F.lit(e))).withColumn("extension", F.lit(e)) for e in (".bval", ".bvec")]
    return w, tables[0].unionByName(tables[1])


def gradient_edges(spark: SparkSession, d: str) -> DataFrame:
    images, tables = _gradients(spark, d)
    return recordings.gradient_edges(tables, images)


def gradient_nearest(spark: SparkSession, d: str) -> DataFrame:
    images, tables = _gradients(spark, d)
    return recordings.gradient_files(images, tables, ".bval")


def association_lookup(spark: SparkSession, d: str) -> DataFrame:
    images, tables = _gradients(spark, d)
    edges = recordings.gradient_edges(tables, images).withColumn("kind", F.lit("Gradient"))
    asked = images.where(F.col("run") != "03").select(F.replace("path", F.lit(".nii.gz"), F.lit(".bvec")).alias("src"))
    return recordings.associated(edges, images.select("path", "subject"), asked, "Gradient")


def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    return recordings.select_rows(views.events(spark, d).select("subject", "event_id"), ["event_id"], [0, 2], ["subject"])


def matched_names(spark: SparkSession, d: str) -> DataFrame:
    names = views.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    fits = lambda pattern, regex=False: recordings.match_names(names, pattern, regex=regex).withColumn("pattern", F.lit(pattern))
    return fits("?o? *").unionByName(fits("*l* ring")).unionByName(fits("^(red|small) .*(t|r)$", True)).unionByName(fits("gear", True)).unionByName(fits("(", True))


def trial_types(spark: SparkSession, d: str) -> DataFrame:
    return recordings.trial_types(recordings.of_trial_type(views.events(spark, d), "click", "view", "error"))


def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("subject", F.col("trial_type").alias("type"), F.when(F.col("amplitude") > 50, "Bad").otherwise("good").alias("status"))
    return recordings.channel_counts(e, ["subject"])


def joined_recordings(spark: SparkSession, d: str) -> DataFrame:
    s = views.signal(spark, d).select(F.floor(F.col("rec") / 4).alias("set"), (F.col("rec") % 4).alias("part"), F.lit(0).alias("ch"), "idx", "value")
    return _rounded(recordings.concatenate(s, ["set"], "part"), "value")


def joined_annotations(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("subject", "run", "event_id", "onset")
    lengths = e.groupBy("subject", "run").agg((F.max("onset") + 1).alias("seconds"))
    return _rounded(recordings.concatenate_annotations(e, lengths, ["subject"], "run"), "onset")


def temporal_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recordings.temporal_mean(views.signal(spark, d).select("grp", F.col("idx").alias("voxel"), "value"), ["grp"]), "mean")


def unique_b_values(spark: SparkSession, d: str) -> DataFrame:
    b = [F.col("p_size") * 100.0, F.col("p_size") * 100 + 0.5, F.lit(0.0), F.col("p_size") * 100 + 3.0]
    table = F.array(*[F.struct(x.alias("b")) for x in b])
    u = recordings.unique_b_values(table)
    return views.read(spark, d, "part").select("p_partkey", F.size(u).alias("n"), F.aggregate(u, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(recordings.b0_places(table)).alias("n_b0"))


def point_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("fiducial", "hpi", "eeg", "extra")))
    return recordings.kind_counts(views.read(spark, d, "events").select(F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("kind")))


def expanded_paths(spark: SparkSession, d: str) -> DataFrame:
    n = views.read(spark, d, "nation").select(F.array(F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("subject"), F.array(F.lit("rest"), F.lit("go")).alias("task"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("run"))
    return recordings.expanded_paths(n, "sub-{subject}/func/sub-{subject}_task-{task}[_run-{run}]_bold.nii.gz")


def blood_tables(spark: SparkSession, d: str) -> DataFrame:
    f = _wide(spark, d).where("suffix = 'meg'").select("path", "subject")
    blood = f.where("CAST(subject AS INT) % 2 = 0").select(F.concat(F.regexp_replace("path", "/[^/]*$", "/sub-"), "subject", F.lit("_blood.tsv")).alias("path")).distinct()
    return recordings.blood_tables(f, blood)


def channel_availability(spark: SparkSession, d: str) -> DataFrame:
    c = views.events(spark, d).select(F.col("subject").alias("input"), F.col("trial_type").alias("channel"))
    rate = recordings.harmonised_rate(c.select("input", (F.lit(128.0) + F.col("input") % 7).alias("rate")), 0.5)
    return recordings.availability(c).crossJoin(F.broadcast(rate))


def derivative_registry(spark: SparkSession, d: str) -> DataFrame:
    n = views.read(spark, d, "nation").select(F.concat(F.lit("/ds/derivatives/"), F.lower("n_name")).alias("root"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).alias("pipeline"))
    return recordings.derivatives(n)


def preprocessed(spark: SparkSession, d: str) -> DataFrame:
    s = views.signal(spark, d).select(F.floor(F.col("rec") / 8).alias("rec"), "ch", "idx", "value")
    events = views.events(spark, d).join(s.agg((F.max("rec") + 1).alias("n")), F.lit(True)).select((F.col("event_id") % F.col("n")).alias("rec"), "event_id", "trial_type", (F.floor(F.col("onset") % 64) / 64).alias("onset"))
    plan = steps.Steps.from_json(steps.Steps("demo").then("drop", channels=[7]).then("z_score").then("average_reference").then("epoch", label="click", start=-0.125, end=0.25).then("epoch", label="error", start=-0.125, end=0.25).then("baseline", start=0.0, end=0.125).to_json())
    e, _ = plan.run(s, 64.0, events)
    return _rounded(e.groupBy("rec", "epoch", "label", "ch").agg(F.count("*").alias("n"), F.sum(F.col("value") * (F.col("idx") + 1)).alias("moment")), "moment")


def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return steps.label_encoded(views.events(spark, d).select("event_id", "trial_type"), F.col("trial_type"))


def densified(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).withColumn("onset", F.floor(F.col("onset"))).withColumn("amplitude", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("amplitude"))).withColumn("duration", F.lit(2.0))
    return _rounded(variables.densify(e, 1, ["subject", "run"]), "value")


QUERIES = {f.__name__: f for f in (
    typed_metadata, metadata_struct, echo_lists, snake_keys, entity_types, schema_validity, vocabulary, repetition_time, file_count, modality_files, gradient_edges, gradient_nearest,
    association_lookup, selected_rows, matched_names, trial_types, channel_counts, joined_recordings, joined_annotations, temporal_mean, unique_b_values, point_kinds, expanded_paths,
    blood_tables, channel_availability, derivative_registry, preprocessed, label_encode, densified,
)}

_E, _S, _W = f"WITH {EVENTS_SQL}", f"WITH {SIGNAL_SQL}", f"WITH {WIDE_SQL}"
_IN = lambda c, values: f"{c} IN ({', '.join(repr(v) for v in values)})"

ORACLES = {
    "typed_metadata": """SELECT p_partkey, CASE WHEN m > 3 AND p_size % 3 <> 0 THEN 2.5 WHEN m = 2 THEN 3 END::DOUBLE AS tr, CASE WHEN m > 3 THEN p_size END::BIGINT AS slices, CASE WHEN m > 3 THEN p_brand END AS maker,
      CASE WHEN m > 3 THEN p_size % 2 = 0 END AS square, CASE WHEN m = 1 THEN 5 END::DOUBLE AS wrong_kind, CASE WHEN m > 3 THEN 1 WHEN m = 2 THEN 0 END::INT AS n_nested, CASE WHEN m > 3 THEN p_size ELSE 0 END::BIGINT AS total
      FROM (SELECT *, p_partkey % 11 AS m FROM part)""",
    "metadata_struct": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size::BIGINT END AS SliceCount, CASE WHEN p_size % 3 <> 0 THEN 2.5::DOUBLE END AS RepetitionTime, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS Manufacturer FROM part",
    "echo_lists": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS n, CASE WHEN p_size % 2 = 0 THEN 3.5 ELSE 0 END::DOUBLE + p_size AS total FROM part",
    "snake_keys": """SELECT p_partkey, '{"repetition_time":' || p_size || ',"nested":[{"mr_transmit_coil":"' || p_brand || '"}]}' AS data FROM part""",
    "entity_types": f"{_W} SELECT path, run::BIGINT AS run, run AS run_text, session::DOUBLE AS session, 0::BIGINT AS task_number, false AS task_flag FROM w",
    "schema_validity": f"{_W} SELECT path, session <> '1996' AS valid FROM w",
    "vocabulary": f"{_W} SELECT {_IN('datatype', config.DATATYPES)} AS datatype, {_IN('suffix', config.SUFFIXES)} AS suffix, {_IN('extension', config.EXTENSIONS)} AS extension, {_IN('task', config.SUFFIXES)} AS task, count(*) AS n FROM w GROUP BY ALL",
    "repetition_time": f"{_W} SELECT round(any_value(('2.50000' || run)::DOUBLE), 5) AS tr FROM w WHERE suffix = 'bold'",
    "file_count": f"{_W} SELECT count(*) AS n FROM w WHERE task = 'O'",
    "modality_files": f"WITH {FILES_SQL} SELECT path FROM f WHERE path LIKE '%/meg/%_meg.fif'",
    "gradient_edges": f"{_W}, i AS (SELECT * FROM w WHERE suffix = 'dwi') SELECT replace(a.path, '.nii.gz', x) AS src, b.path AS dst FROM i a JOIN i b ON a.subject = b.subject AND a.session = b.session AND a.run = b.run, (VALUES ('.bval'), ('.bvec')) v(x)",
    "gradient_nearest": f"""{_W}, i AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM w WHERE suffix = 'dwi')
      SELECT path, nearest FROM (SELECT a.path, replace(b.path, '.nii.gz', '.bval') AS nearest, row_number() OVER (PARTITION BY a.path ORDER BY (a.run = b.run)::INT DESC, replace(b.path, '.nii.gz', '.bval')) AS r FROM i a JOIN i b ON a.dir = b.dir) WHERE r = 1""",
    "association_lookup": f"""{_W}, i AS (SELECT * FROM w WHERE suffix = 'dwi') SELECT replace(a.path, '.nii.gz', '.bvec') AS src, b.path, 'Gradient' AS kind, b.subject FROM i a JOIN i b
      ON a.subject = b.subject AND a.session = b.session AND a.run = b.run WHERE a.run <> '03'""",
    "selected_rows": f"{_E} SELECT subject, event_id FROM (SELECT subject, event_id, row_number() OVER (PARTITION BY subject ORDER BY event_id) AS r FROM e) WHERE r IN (1, 3)",
    "matched_names": r"""WITH n AS (SELECT DISTINCT p_name AS name FROM part)
      SELECT name, '?o? *' AS pattern FROM n WHERE name LIKE '_o_ %' UNION ALL SELECT name, '*l* ring' FROM n WHERE name LIKE '%l% ring'
      UNION ALL SELECT name, '^(red|small) .*(t|r)$' FROM n WHERE regexp_matches(name, '^(red|small) .*(t|r)$') UNION ALL SELECT name, 'gear' FROM n WHERE contains(name, 'gear')""",
    "trial_types": f"{_E} SELECT DISTINCT trial_type FROM e WHERE trial_type IN ('click', 'view', 'error')",
    "channel_counts": f"{_E} SELECT subject, trial_type AS type, count(*) AS n, count(*) FILTER (amplitude > 50) AS n_bad FROM e GROUP BY ALL",
    "joined_recordings": f"{_S} SELECT (rec // 4)::BIGINT AS set, rec % 4 AS part, 0 AS ch, (idx + 64 * (rec % 4 - min(rec % 4) OVER (PARTITION BY rec // 4)))::BIGINT AS idx, {_r('value')} AS value FROM s",
    "joined_annotations": f"{_E}, l AS (SELECT subject, run, max(onset) + 1 AS seconds FROM e GROUP BY ALL), t AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l) SELECT subject, run, event_id, {_r('onset + start')} AS onset FROM e JOIN t USING (subject, run)",
    "temporal_mean": f"{_S} SELECT grp, idx AS voxel, {_r('avg(value)')} AS mean, count(*) AS n_volumes FROM s GROUP BY grp, idx",
    "unique_b_values": "SELECT p_partkey, 3 AS n, (200 * p_size + 3)::DOUBLE AS total, 1 AS n_b0 FROM part",
    "point_kinds": "SELECT count(*) FILTER (event_id % 4 = 0) AS n_fiducial, count(*) FILTER (event_id % 4 = 1) AS n_hpi, count(*) FILTER (event_id % 4 = 2) AS n_eeg, count(*) FILTER (event_id % 4 = 3) AS n_extra FROM events",
    "expanded_paths": "SELECT printf('sub-%02d/func/sub-%02d_task-%s_run-%d_bold.nii.gz', n_nationkey, n_nationkey, t, r) AS path FROM nation, (VALUES ('rest'), ('go')) a(t), range(1, 4) b(r)",
    "blood_tables": f"{_W} SELECT path, regexp_replace(path, '/[^/]*$', '/sub-') || subject || '_blood.tsv' AS blood FROM w WHERE suffix = 'meg' AND subject::INT % 2 = 0",
    "channel_availability": f"{_E} SELECT trial_type AS channel, count(DISTINCT subject) AS n_inputs, (SELECT min(128.5 + subject % 7) FROM e)::DOUBLE AS rate FROM e GROUP BY trial_type",
    "derivative_registry": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'p' || n_nationkey ELSE lower(n_name) END AS pipeline, '/ds/derivatives/' || lower(n_name) AS root FROM nation",
    "preprocessed": f"""WITH {SIGNAL_SQL}, {EVENTS_SQL.lstrip()},
      r AS (SELECT rec // 8 AS rec, ch, idx, value - avg(value) OVER (PARTITION BY rec // 8, idx) AS value FROM s WHERE ch <> 7),
      m AS (SELECT event_id % (SELECT max(rec) + 1 FROM r) AS rec, event_id, trial_type AS label, floor(onset % 64)::INT AS pos FROM e WHERE trial_type IN ('click', 'error')),
      x AS (SELECT m.rec, m.event_id AS epoch, label, ch, idx - pos + 8 AS idx, value FROM m JOIN r ON m.rec = r.rec AND idx >= pos - 8 AND idx < pos + 16 WHERE pos >= 8 AND pos + 16 <= 64),
      b AS (SELECT *, value - avg(CASE WHEN idx < 8 THEN value END) OVER (PARTITION BY rec, epoch, label, ch) AS v FROM x)
      SELECT rec, epoch, label, ch, count(*) AS n, {_r('sum(v * (idx + 1))')} AS moment FROM b GROUP BY ALL""",
    "label_encode": f"{_E} SELECT event_id, trial_type, (dense_rank() OVER (ORDER BY trial_type) - 1)::INT AS code FROM e",
    "densified": f"{_E}, b AS (SELECT subject, run, floor(onset)::BIGINT + k AS bin, floor(onset) AS o, event_id, amplitude FROM e, range(0, 2) x(k) WHERE event_id % 5 <> 0) SELECT subject, run, bin, {_r('arg_max(amplitude, (o, event_id))')} AS value FROM b GROUP BY ALL",
}
