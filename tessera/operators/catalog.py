"""The catalog: files and tags from paths, and conjunctive queries on the tags.

All tag values are text. A query is a list of conditions on entities. On a stored tag table its plan reads the
tags of these entities once, checks all conditions in one aggregation per path, and leaves anti conditions to
the rows without a tag. Without a tag table (CatalogQuery.of_paths) each condition is a filter on the path itself:
only the patterns of the entities asked for are matched, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths


def files(df: DataFrame, path_col: str = "path") -> DataFrame:
    """path, filename, dirname, file_type, extension and suffix of distinct paths."""
    p = F.col("path")
    return df.select(F.col(path_col).alias("path")).where(p.isNotNull()).distinct().select(
        "path", paths.filename(p).alias("filename"), paths.dirname(p).alias("dirname"), paths.file_type(p).alias("file_type"), paths.extension(p).alias("ext"), paths.suffix(p).alias("stem_suffix")
    )


def wide(df: DataFrame, *, derivatives: bool = False) -> DataFrame:
    """path and a column for each entity."""
    return df.select("path", *[c.alias(n) for n, c in paths.entities(F.col("path"), derivatives=derivatives).items()])


def tags(df: DataFrame, *, derivatives: bool = False) -> DataFrame:
    """path, entity, value: a row for each entity that a path has."""
    return df.select("path", F.explode(paths.tags(F.col("path"), derivatives=derivatives)).alias("t")).select("path", "t.entity", "t.value")


def entity_counts(tags_: DataFrame) -> DataFrame:
    """entity, n_tags, n_values of a tag table."""
    return tags_.groupBy("entity").agg(F.count("*").alias("n_tags"), F.countDistinct("value").alias("n_values"))


def zarr_directories(df: DataFrame) -> DataFrame:
    """path of each directory whose name ends in .zarr, which counts as one file."""
    return df.select(F.regexp_extract("path", r"^(.*?\.zarr)/", 1).alias("path")).where("path != ''").distinct()


def catalogued(df: DataFrame) -> DataFrame:
    """Paths outside .zarr directories, and these directories."""
    return df.where(~F.col("path").rlike(r"\.zarr/")).select("path").union(zarr_directories(df))


@dataclass(frozen=True)
class Condition:
    """One condition on an entity: kind is any, none, in or regex."""

    entity: str
    kind: str
    values: tuple[str, ...] = ()

    def holds(self, value: Column) -> Column:
        """Whether a tag's value satisfies it."""
        if self.kind == "in":
            return value.isin(*self.values)
        if self.kind == "regex":
            return value.rlike(self.values[0])
        return value.isNotNull()


@dataclass(frozen=True)
class CatalogQuery:
    """A conjunction of conditions over a catalog; every method returns a new query. tags: None reads them off the paths."""

    files: DataFrame
    tags: DataFrame | None
    conditions: tuple[Condition, ...] = ()

    @staticmethod
    def of_paths(files: DataFrame) -> CatalogQuery:
        """A query on files whose entities are read off their paths."""
        return CatalogQuery(files, None)

    def value(self, entity: str) -> Column:
        """The entity of a path; null for entities that no path can have."""
        pattern = dict(config.ENTITIES + config.DERIVATIVE_ENTITIES).get(entity)
        return paths.entity(F.col("path"), pattern) if pattern else F.lit(None).cast("string")

    def _with(self, *c: Condition) -> CatalogQuery:
        return replace(self, conditions=(*self.conditions, *c))

    def equals(self, entity: str, value: str) -> CatalogQuery:
        """The entity has this text."""
        return self._with(Condition(entity, "in", (value,)))

    def one_of(self, entity: str, *values: str) -> CatalogQuery:
        """The entity has one of these texts; no texts are no condition."""
        return self._with(Condition(entity, "in", values)) if values else self

    def equals_int(self, entity: str, value: int) -> CatalogQuery:
        """The entity is this number, however it is padded."""
        return self._with(Condition(entity, "regex", (f"^0*{value}$",)))

    def regex(self, entity: str, pattern: str) -> CatalogQuery:
        """The pattern is found in the entity's text."""
        return self._with(Condition(entity, "regex", (pattern,)))

    def any(self, entity: str) -> CatalogQuery:
        """The entity is there."""
        return self._with(Condition(entity, "any"))

    def none(self, entity: str) -> CatalogQuery:
        """The entity isn't there."""
        return self._with(Condition(entity, "none"))

    def optional(self, entity: str) -> CatalogQuery:
        """No condition."""
        return self

    def extension(self, value: str) -> CatalogQuery:
        """The extension, with or without its dot."""
        return self.equals("extension", value if value.startswith(".") else "." + value)

    def subject(self, v: str) -> CatalogQuery:
        """The subject has this text; so do the other shorthands with their entities."""
        return self.equals("subject", v)

    def session(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("session", v)

    def task(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("task", v)

    def run(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("run", v)

    def datatype(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("datatype", v)

    def suffix(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("suffix", v)

    def acquisition(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("acquisition", v)

    def recording(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("recording", v)

    def space(self, v: str) -> CatalogQuery:
        """See subject()."""
        return self.equals("space", v)

    def checked(self, unknown: str = "error") -> CatalogQuery:
        """The query with its entities checked against those of the catalog: unknown ones are an error, dropped or allowed."""
        if unknown not in ("error", "drop", "allow"):
            raise ValueError(f"unknown must be error, drop or allow, not {unknown}")
        wrong = [] if unknown == "allow" else unknown_entities(self)
        if wrong and unknown == "error":
            raise ValueError("; ".join(f"no file has the entity {w}" + (f", did you mean {', '.join(near)}?" if near else "") for w, near in wrong))
        names = {w for w, _ in wrong}
        return replace(self, conditions=tuple(c for c in self.conditions if c.entity not in names))

    def count(self) -> DataFrame:
        """n: the number of files found."""
        return self.paths().agg(F.count("*").alias("n"))

    def scope(self, scope: str) -> CatalogQuery:
        """Files with the column pipeline null (raw), not null (derivatives), equal (a name), or all."""
        where = {"all": F.lit(True), "raw": F.col("pipeline").isNull(), "derivatives": F.col("pipeline").isNotNull()}
        return replace(self, files=self.files.where(where.get(scope, F.col("pipeline") == scope)))

    def paths(self) -> DataFrame:
        """The files that satisfy every condition."""
        if self.tags is None:
            out = self.files
            for c in self.conditions:
                v = self.value(c.entity)
                out = out.where(v.isNull() if c.kind == "none" else c.holds(v))
            return out
        need = [c for c in self.conditions if c.kind != "none"]
        bar = [c.entity for c in self.conditions if c.kind == "none"]
        out = self.files
        if need:
            names = sorted({c.entity for c in need})
            flags = [F.bool_or((F.col("entity") == c.entity) & c.holds(F.col("value"))).alias(f"c{k}") for k, c in enumerate(need)]
            keep = self.tags.where(F.col("entity").isin(*names)).groupBy("path").agg(*flags)
            for k in range(len(need)):
                keep = keep.where(F.col(f"c{k}"))
            out = out.join(keep.select("path"), "path", "left_semi")
        if bar:
            out = out.join(self.tags.where(F.col("entity").isin(*bar)).select("path"), "path", "left_anti")
        return out

    def unique(self, entity: str) -> DataFrame:
        """The distinct values of an entity among the files found."""
        if self.tags is None:
            return self.any(entity).paths().select(self.value(entity).alias("value")).distinct()
        return self.tags.where(F.col("entity") == entity).join(self.paths().select("path"), "path", "left_semi").select("value").distinct()

    def directories(self, entity: str) -> DataFrame:
        """The distinct directories of the files found that have the entity."""
        return self.any(entity).paths().select(paths.dirname(F.col("path")).alias("directory")).distinct()

    def collect_maps(self) -> DataFrame:
        """The files found with their tags as a map."""
        if self.tags is None:
            return self.paths().select("path", F.map_from_entries(F.array_sort(paths.tags(F.col("path")))).alias("entities"))
        found = self.tags.join(self.paths().select("path"), "path", "left_semi")
        return found.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("entity", "value")))).alias("entities"))


def unknown_entities(query: CatalogQuery) -> list[tuple[str, list[str]]]:
    """Entities of the conditions that no tag has, each with up to three near names; entity names are few."""
    known = [n for n, _ in config.ENTITIES] if query.tags is None else [r.entity for r in query.tags.select("entity").distinct().collect()]
    wrong = sorted({c.entity for c in query.conditions} - set(known))
    if not wrong:
        return []
    spark = query.files.sparkSession
    pairs = close_matches(spark.createDataFrame([(w,) for w in wrong], "word string"), spark.createDataFrame([(k,) for k in known], "candidate string"), 3)
    near = {r.word: list(r.names) for r in pairs.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x.candidate).alias("names")).collect()}
    return [(w, near.get(w, [])) for w in wrong]


def close_matches(words: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """word, candidate, distance, rank: the n nearest candidates by edit distance, no farther than max(length, 3).

    words is a handful of names that a user asked for, and is broadcast; candidates stay where they are.
    """
    from pyspark.sql import Window

    d = candidates.crossJoin(words).withColumn("distance", F.levenshtein(F.lower("word"), F.lower("candidate")))
    d = d.where(F.col("distance") <= F.greatest(F.length("word"), F.lit(3)))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))).where(F.col("rank") <= n)


def matches_entities(entities: Column, target: dict[str, str], *, strict: bool = False) -> Column:
    """A map of entities has all of target; strict: and nothing else."""
    test = F.lit(True)
    for k, v in target.items():
        test = test & (F.coalesce(F.try_element_at(entities, F.lit(k)), F.lit("")) == v)
    return test & (F.size(entities) == len(target)) if strict else test


#: Entities in which files of one group may differ.
_ALIKE = ("echo", "part", "ch", "direction", "suffix")


def associated_groups(df: DataFrame) -> DataFrame:
    """path and group: files that differ only in echo, part, channel, direction or suffix share a group. df: files, or their tags."""
    if "entity" not in df.columns:
        named = [F.concat(F.lit(f"{n}="), c) for n, c in paths.entities(F.col("path")).items() if n not in _ALIKE]
        return df.select("path", F.array_join(F.array_sort(F.array_compact(F.array(*named))), "|").alias("group"))
    left = ~F.col("entity").isin(*_ALIKE)
    key = F.array_join(F.array_sort(F.collect_set(F.when(left, F.concat_ws("=", "entity", "value")))), "|")
    return df.groupBy("path").agg(key.alias("group"))
