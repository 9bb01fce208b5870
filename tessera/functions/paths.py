"""Column functions on paths: entities, types, extensions, natural order, path building."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config


def entity(path: Column, pattern: str) -> Column:
    """The first group of pattern in path, null if there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def entities(path: Column, *, derivatives: bool = False) -> dict[str, Column]:
    """A column for each configured entity."""
    return {name: entity(path, p) for name, p in config.ENTITIES + (config.DERIVATIVE_ENTITIES if derivatives else [])}


#: What an entity's pattern looks like that is a key after a separator, a hyphen and a value.
_KEYED = re.compile(r"^\[_/\\\\\]\+([a-z]+)-\((.*)\)$")


def tags(path: Column, *, derivatives: bool = False) -> Column:
    """array<struct<entity, value>> of the entities that a path has, in one pass over it for all keys with values.

    These stand after a separator, and no value holds one, so one expression finds them all; of equal keys the first counts.
    The few entities of other kinds have a pattern each.
    """
    keyed = {m[1]: (name, m[2]) for name, p in config.ENTITIES if (m := _KEYED.match(p))}
    pattern = r"[_/\\]+(?:" + "|".join(f"{k}-(?:{v})" for k, (_, v) in keyed.items()) + ")"
    names = F.create_map(*[F.lit(x) for k, (name, _) in keyed.items() for x in (k, name)])
    found = F.transform(F.regexp_extract_all(path, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"^[_/\\]+", ""))

    def tag(x: Column) -> Column:
        return F.struct(F.element_at(names, F.substring_index(x, "-", 1)).alias("entity"), F.substring_index(x, "-", -1).alias("value"))

    #: Bound once as a lambda's argument, so that the path isn't searched again for each use.
    pairs = F.flatten(F.transform(F.array(F.transform(found, tag)), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y.entity), x.entity) == i + 1)))
    others = [(n, p) for n, p in config.ENTITIES if not _KEYED.match(p)] + (config.DERIVATIVE_ENTITIES if derivatives else [])
    single = F.array(*[F.struct(F.lit(n).alias("entity"), entity(path, p).alias("value")) for n, p in others])
    return F.concat(pairs, F.filter(single, lambda x: x.value.isNotNull()))


def filename(path: Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The part before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def file_type(path: Column) -> Column:
    """The file type by the name's ending; generic if none fits."""
    out = F
    for name, ends in config.FILE_TYPES:
        test = F.lit(False)
        for e in ends:
            test = test | path.endswith(e)
        out = out.when(test, name)
    return out.otherwise("generic")


def extension(path: Column) -> Column:
    """The extension, compound ones whole; empty if there is none."""
    name = filename(path)
    out = F
    for e in config.COMPOUND_EXTENSIONS:
        out = out.when(name.endswith(e), e)
    return out.otherwise(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def suffix(path: Column) -> Column:
    """The last token of the stem."""
    return F.element_at(F.split(F.substring_index(filename(path), ".", 1), "_"), -1)


def companion(path: Column, new_suffix: str, ext: str) -> Column:
    """The path of the file beside it with another suffix and extension."""
    stem = F.substring_index(filename(path), ".", 1)
    base = F.when(F.contains(stem, F.lit("_")), F.regexp_extract(stem, "^(.*)_[^_]*$", 1)).otherwise(stem)
    return F.concat(dirname(path), F.lit("/"), base, F.lit(f"_{new_suffix}.{ext}"))


def ancestors(path: Column) -> Column:
    """The directories above path from the root down, as array<struct<depth, dir>>."""
    parts = F.split(dirname(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def natural_key(text: Column) -> Column:
    """A string whose order is the natural order: lower case, runs of digits as 20 digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.coalesce(F.nullif(F.ltrim(r, F.lit("0")), F.lit("")), F.lit("0")), 20, "0")).otherwise(r))
    return F.array_join(padded, "")


def canonical_rank(name: Column) -> Column:
    """The place of an entity in the canonical order; unknown ones come last."""
    table = {n: k for k, n in enumerate(config.ENTITY_ORDER)} | {a: config.ENTITY_ORDER.index(n) for a, n in config.ORDER_ALIASES.items()}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(len(config.ENTITY_ORDER)))


def is_valid(path: Column, root: str) -> Column:
    """A file of the root, or one whose first component under it is a subject."""
    rest = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return path.startswith(root.rstrip("/") + "/") & (~F.contains(rest, F.lit("/")) | rest.rlike("^sub-[a-zA-Z0-9+]+/"))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """One of the regular expressions is found in path."""
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def glob_pattern(glob: str) -> str:
    """A glob with * and ? as an anchored regular expression; without a slash it is one of the last component."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)
    return f"^{body}$" if "/" in glob else f"(?:^|/){body}$"


def build_path(values: Mapping[str, Column], pattern: str) -> Column:
    """A path from a pattern: {e}, {e<a|b>}, {e|default}, and [optional] parts that need all their entities.

    Null where a needed entity is null, or its value isn't among the allowed ones.
    """
    null = F.lit(None).cast("string")

    def field(spec: str) -> Column:
        name, allowed, default = re.fullmatch(r"(\w+)(?:<([^>]*)>)?(?:\|(.*))?", spec).groups()
        value = values.get(name, null)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        if allowed:
            value = F.when(value.rlike(f"^(?:{'|'.join(x.replace('.', chr(92) + '.') for x in allowed.split('|'))})$"), value)
        return value

    def part(text: str) -> Column:
        pieces = [field(x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.findall(r"\{[^}]*\}|[^{]+", text)]
        return F.concat(*pieces) if pieces else F.lit("")

    out, at = [], 0
    for m in re.finditer(r"\[((?:[^\[\]{}]|\{[^}]*\})*\{[^}]*\}(?:[^\[\]{}]|\{[^}]*\})*)\]", pattern):
        out += [part(pattern[at : m.start()]), F.coalesce(part(m[1]), F.lit(""))]
        at = m.end()
    return F.concat(*out, part(pattern[at:]))
