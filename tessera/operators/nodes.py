"""The levels of a dataset as nodes: dataset, subjects, sessions and runs, and searches in them.

An entity that a node or a search lacks fits any value. Rows are joined on the subject if both have it, else on the entities
that both have: each side is repeated for the sets of entities that the other may have (four bits), so the join is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITIES = ("subject", "session", "task", "run")
#: Levels from the highest on, with the entities that their nodes may have.
LEVELS = {"dataset": (), "subject": ("subject",), "session": ("subject", "session"), "run": ENTITIES}


def nodes(wide: DataFrame) -> DataFrame:
    """level, subject, session, task, run, n_files, image: the nodes of a wide catalog; image is the first path of a run's files.

    Subjects are those of any file, sessions those of files that name one, runs the combinations of files with a task.
    """
    none = lambda c: F.lit(None).cast("string").alias(c)
    needs = {"dataset": F.lit(True), "subject": F.col("subject").isNotNull(), "session": F.col("session").isNotNull(), "run": F.col("task").isNotNull()}
    #: A file counts in one node of each level, so it is repeated for the levels instead of read for each.
    row = lambda level, has: F.struct(F.lit(level).alias("level"), *[F.col(e).cast("string").alias(e) if e in has else none(e) for e in ENTITIES])
    rows = F.array_compact(F.array(*[F.when(needs[k], row(k, v)) for k, v in LEVELS.items()]))
    found = wide.select("path", F.inline(rows)).groupBy("level", *ENTITIES).agg(F.count("*").alias("n_files"), F.min("path").alias("image"))
    return found.withColumn("image", F.when(F.col("level") == "run", F.col("image")))


def _mask(prefix: str = "") -> Column:
    return sum((F.when(F.col(f"{prefix}{e}").isNotNull(), 1 << k).otherwise(0) for k, e in enumerate(ENTITIES)), F.lit(0))


def _shared(both: Column) -> Column:
    """The values of the entities in a set of bits, as one text; each with its length, so that no two differ only in their seams."""
    parts = [F.when(both.bitwiseAND(F.lit(1 << k)) > 0, F.concat(F.length(e).cast("string"), F.lit(":"), F.col(e))) for k, e in enumerate(ENTITIES)]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts])


#: Leading characters of a subject that tell its range.
RANGE = 3


def _meeting(own: Column, other: Column, w: Column, t: Column) -> Column:
    """What a search of the set of entities w and a node of the set t are joined by: the subject alone where both have it, else all they share.

    A subject's nodes are few, so a node isn't repeated for each set of entities that searches of its subject may have.
    """
    both = own.bitwiseAND(other)
    return F.when(both.bitwiseAND(F.lit(1)) > 0, F.concat(F.lit("="), F.col(ENTITIES[0]))).otherwise(F.concat_ws("|", w.cast("string"), t.cast("string"), _shared(both)))


def find_nodes(wanted: DataFrame, tree: DataFrame, *, level: str | None = None) -> DataFrame:
    """id, rank, level, subject, session, task, run, n_files, image: the nodes that fit each search, in the order of their entities.

    wanted: id and entities, null where a search doesn't name one. level: nodes of that level only. Searches for the same are
    answered once, so nodes that many broad searches find are sorted once, and dealt out to the searches last.
    """
    t = tree.where(F.col("level") == level) if level else tree
    w = wanted.select("id", *[F.col(e).cast("string").alias(e) for e in ENTITIES])
    #: An id is one search, even if it stands in several rows.
    w = w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*ENTITIES))).alias("_rows")).withColumn("_ask", F.to_json("_rows"))
    asked = w.select("_ask", "_rows").distinct().select("_ask", F.explode("_rows").alias("_row")).select("_ask", "_row.*").withColumn("_m", _mask())
    t = t.withColumn("_m", _mask())
    own = F.col("_m")
    #: The sets of entities that searches have: one row of sixteen at most.
    sets = asked.agg(F.collect_set("_m").alias("_sets"))
    t = t.crossJoin(F.broadcast(sets)).withColumn("_key", F.explode(F.array_distinct(F.transform("_sets", lambda o: _meeting(own, o, o, own)))))
    keys = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in range(16)]), lambda o: _meeting(own, o, own, o)))
    asked = asked.select("_ask", *[F.col(e).alias(f"_{e}") for e in ENTITIES], F.explode(keys).alias("_key"))
    found = asked.join(t, "_key")
    for e in ENTITIES:
        found = found.where(F.col(f"_{e}").isNull() | F.col(e).isNull() | (F.col(f"_{e}") == F.col(e)))
    #: Ranges of subjects are counted, and ranks within a range start where the ranges before it end, so no task sorts all nodes.
    found = found.select("_ask", F.coalesce(F.substring(ENTITIES[0], 1, RANGE), F.lit("")).alias("_range"), "level", *ENTITIES, "n_files", "image")
    upto = Window.partitionBy("_ask").orderBy("_range")
    ranges = found.groupBy("_ask", "_range").agg(F.count("*").alias("_n")).select("_ask", "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_ask", "_range").orderBy(*[F.col(e).asc_nulls_first() for e in ENTITIES], "level")
    ranked = found.withColumn("_i", F.row_number().over(order))
    #: A search asks for each of its ranges, so what broad ones find is dealt out by ranges, too.
    dealt = w.select("id", "_ask").join(ranges, "_ask")
    return ranked.join(dealt, ["_ask", "_range"]).select("id", (F.col("_before") + F.col("_i")).cast("int").alias("rank"), "level", *ENTITIES, "n_files", "image")


def _name(level: str, entities: tuple[str, ...]) -> Column:
    """A level and the values of some of its entities as one text; the others stand as missing."""
    return F.concat_ws("|", F.lit(level), *[F.coalesce(F.concat(F.length(e).cast("string"), F.lit(":"), F.col(e)), F.lit("-")) if e in entities else F.lit("-") for e in LEVELS[level]])


def nearest_node(wanted: DataFrame, tree: DataFrame, *, at_most: str = "run") -> DataFrame:
    """id, level, subject, session, task, run: for each search the deepest node at or above a level whose entities it names, all equal.

    As-of by level: a run, else a session, the subject, or the dataset; of several runs the one with more entities. Null
    where there is no node at all.
    """
    levels = list(LEVELS)[: list(LEVELS).index(at_most) + 1]
    w = wanted.select("id", *[F.col(e).cast("string").alias(e) for e in ENTITIES])
    #: A run's node may lack a session or a run. The dataset's node, which all searches would ask for, is one row.
    sets = {"subject": [("subject",)], "session": [("subject", "session")], "run": [ENTITIES, ("subject", "task", "run"), ("subject", "session", "task"), ("subject", "task")]}
    keys = [_name(n, s) for n in levels if n != "dataset" for s in sets[n]]
    depth = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(levels) for x in (n, k)]), F.col("level"))
    size = sum((F.col(e).isNotNull().cast("int") for e in ENTITIES), F.lit(0))
    named = F.coalesce(*[F.when(F.col("level") == n, _name(n, LEVELS[n])) for n in levels])
    t = tree.where(F.col("level").isin(*levels)).select(named.alias("_key"), F.struct(depth.alias("depth"), size.alias("size"), F.col("session").isNotNull().alias("_s"), "level", *ENTITIES).alias("node"))
    best = w.select("id", F.explode(F.array_distinct(F.array(*keys, F.lit("")))).alias("_key")).join(t, "_key").groupBy("id").agg(F.max("node").alias("node"))
    top = t.where("node.level = 'dataset'").agg(F.max("node").alias("top"))
    out = w.select("id").join(best, "id", "left").crossJoin(top)
    return out.select("id", F.coalesce("node", "top").alias("node")).select("id", "node.level", *[f"node.{e}" for e in ENTITIES])
