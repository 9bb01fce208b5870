"""Column functions on names and texts: tag strings, letter case, grammatical number, versions, report phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hed_tags(text: Column) -> Column:
    """The tags of a string like `A, (B, C)`, groups flattened, in order."""
    flat = F.translate(text, "()", ",,")
    return F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: x != "")


def hed_tree(text: Column) -> Column:
    """array<struct<tag, children>>: single tags have no children, groups no tag."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\([^()]*\)|[^,()]+)"), F.lit(1))
    shown = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")

    def node(x: Column) -> Column:
        group = x.startswith("(")
        none = F.array().cast("array<string>")
        return F.struct(F.when(~group, x).alias("tag"), F.when(group, hed_tags(x)).otherwise(none).alias("children"))

    return F.transform(shown, node)


def camel_to_snake(name: Column) -> Column:
    """RepetitionTime to repetition_time; acronyms stay together."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(split)


def snake_to_camel(name: Column) -> Column:
    """repetition_time to RepetitionTime."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


# Words whose number doesn't follow the rules (singular, plural).
IRREGULAR = [
    ("person", "people"), ("man", "men"), ("woman", "women"), ("child", "children"), ("tooth", "teeth"), ("foot", "feet"), ("mouse", "mice"),
    ("goose", "geese"), ("ox", "oxen"), ("leaf", "leaves"), ("life", "lives"), ("axis", "axes"), ("analysis", "analyses"), ("datum", "data"),
]
# Words whose singular and plural are the same.
SAME = ["equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "deer", "aircraft", "news"]
#: Endings of plurals and their singulars, the first that fits counts; and the other way.
TO_SINGULAR = [("(ss|us|is)$", "$1"), ("(x|ch|sh|ss|zz|us)es$", "$1"), ("([^aeiou])ies$", "$1y"), ("ves$", "f"), ("(o)es$", "$1"), ("s$", "")]
TO_PLURAL = [("(x|ch|sh|ss|zz|s)$", "$1es"), ("([^aeiou])y$", "$1ies"), ("(?:fe|f)$", "ves"), ("([^aeiou]o)$", "$1es"), ("$", "s")]


def _by_rules(word: Column, table: list[tuple[str, str]], rules: list[tuple[str, str]]) -> Column:
    out = F.when(F.lower(word).isin(*SAME), word)
    for a, b in table:
        out = out.when(F.lower(word) == a, b)
    for pattern, to in rules:
        out = out.when(word.rlike(pattern), F.regexp_replace(word, pattern, to))
    return out.otherwise(word)


def singular(word: Column) -> Column:
    """The singular of a noun."""
    return _by_rules(word, [(p, s) for s, p in IRREGULAR], TO_SINGULAR)


def plural(word: Column) -> Column:
    """The plural of a noun."""
    return _by_rules(word, IRREGULAR, TO_PLURAL)


def version(text: Column) -> Column:
    """struct<major, minor, patch> of `1.8.0` or `1.8`; null where it isn't one. Structs compare as versions do."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*v?(\d+)\.(\d+)(?:\.(\d+))?\s*$", k), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(text.rlike(r"^\s*v?\d+\.\d+(\.\d+)?\s*$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compatibility(have: Column, want: Column) -> Column:
    """exact, compatible (same major, not newer), newer or incompatible of two versions."""
    a, b = version(have), version(want)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(a == b, "exact").when(a.major != b.major, "incompatible").when(a < b, "compatible").otherwise("newer")


def without_repeats(items: Column) -> Column:
    """A list with each item where it first stands."""
    return F.array_distinct(items)


def joined(items: Column) -> Column:
    """A list in words: a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


# Numbers in words.
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def number_word(n: Column) -> Column:
    """Numbers up to ten in words, others in digits."""
    return F.coalesce(F.get(F.array(*map(F.lit, NUMBERS)), n.cast("int")), n.cast("string"))


def repetition_phrase(tr_s: Column) -> Column:
    """TR=2000ms of a time in seconds."""
    return F.when(tr_s.isNotNull(), F.concat(F.lit("TR="), F.round(tr_s * 1000).cast("bigint").cast("string"), F.lit("ms")))
