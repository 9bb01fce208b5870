"""Quality rules: text statistics, and the frequency of lines across the documents of a host.

DataFrame functions only. Normalised lines (A-Z lower-cased, digits as 0, white space as one blank,
trimmed) are hashed; for each host the distinct documents of a line are counted, exact copies of a text
once, so that a copied document isn't taken for boilerplate. Lines in more than LINE_SHARE of the host's
distinct documents, and in more than LINE_DOCS of them, are removed; a document that keeps fewer than
MIN_WORDS words or less than KEEP_SHARE of them is rejected.

Defined results: a null or empty text has no words and fails the base rules. A null host is a host of its
own. Repeated rows keep a row each and get the same verdict. An empty table gives an empty result. Extra
columns are not read by score() and passed on by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import OTHER_SPACE, SPACE, materialize, release

#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Lines above both limits are removed.
LINE_SHARE = 0.05
LINE_DOCS = 20
#: A document that keeps less of its words than this is depleted.
KEEP_SHARE = 0.3


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def base_statistics(docs: DataFrame, *, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns of keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Arrays that a lambda indexes are columns of an earlier projection, so that they are computed once.
    """
    text = _text(text_col)
    kept = [f"_k{i}" for i in range(len(keep))]
    d = docs.select(
        *[c.alias(k) for c, k in zip(keep, kept, strict=True)],
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"),
    )
    d = d.select(
        *kept,
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"),
    )
    d = d.select(
        *kept,
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.size("_w").cast("long").alias("n_words"),
        F.when(
            F.size("_w") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(WINDOW)])),
        ).alias("_h"),
    )
    h = F.col("_h")
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    d = d.select(
        *kept,
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_words",
        F.when(repeats, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"),
    )
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1).h == x.h) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False)))
    d = d.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x.i)))).drop("_s")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    #: A filter isn't pushed below a generator; below the projections it would work the arrays out again for each element.
    numbers = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select(*kept, F.inline(F.array(F.struct(*numbers, failed.alias("base_failed")))))


def _lines(docs: DataFrame, *, text_col: str, host_col: str) -> DataFrame:
    """host, text_key and lines (hash and words of each normalised line with a word) of every row, as a table.

    White space and case are levelled over the whole text before it is cut into lines.
    """
    blanks = OTHER_SPACE.replace("\n", "")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    flat = F.translate(_text(text_col), upper + "123456789" + blanks, upper.lower() + "000000000" + " " * len(blanks))
    words = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.array_remove(F.split(x, " "), "")), lambda w: F.size(w) > 0)
    lines = F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("line_hash"), F.size(w).alias("n")))
    return materialize(docs.select(F.col(host_col).alias("host"), _text_key(_text(text_col)).alias("text_key"), lines.alias("lines")), "lines")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def depleted(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, text_key of the distinct documents that lose too many words with the lines above the limits, as a table."""
    d = _lines(docs, text_col=text_col, host_col=host_col)
    line = d.select("host", "text_key", F.inline("lines"))
    #: Copies of a document are one document, whose repeated lines count once.
    counts = line.select("host", "line_hash", "text_key").distinct().groupBy("host", "line_hash").count().where(F.col("count") > LINE_DOCS)
    copies = materialize(d.groupBy("host", "text_key").agg(F.count("*").alias("copies")), "copies")
    hosts = copies.groupBy("host").agg(F.count("*").alias("n_docs"))
    above = (
        counts.join(hosts, counts.host.eqNullSafe(hosts.host))
        .where(F.col("count") > LINE_SHARE * F.col("n_docs"))
        .select(counts.host.alias("a_host"), F.col("line_hash").alias("a_hash"), F.lit(True).alias("above"))
    )
    above = materialize(above, "above")
    marked = line.join(above, line.host.eqNullSafe(F.col("a_host")) & (line.line_hash == F.col("a_hash")), "left")
    #: Each copy counts its own lines, so the shares are those of one text.
    sums = marked.groupBy("host", "text_key").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("above"), F.lit(0)).otherwise(F.col("n"))).alias("left_words"), F.count("above").alias("removed"))
    lost = sums.where("removed > 0").join(copies, sums.host.eqNullSafe(copies.host) & (sums.text_key == copies.text_key))
    few = (F.col("left_words") < MIN_WORDS * F.col("copies")) | (F.col("left_words") < KEEP_SHARE * F.col("words"))
    #: As a table its size is known before it is joined: where it is small, the documents aren't shuffled.
    out = materialize(lost.where(few).select(sums.host, sums.text_key), "depleted")
    for table in (d, copies, above):
        release(table)
    return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The base statistics, base_failed and kept of every row."""
    base = base_statistics(docs, text_col=text_col, keep=[F.col(id_col), F.col(host_col), _text_key(_text(text_col))])
    lost = depleted(docs, text_col=text_col, host_col=host_col).select(F.col("host").alias("l_host"), F.col("text_key").alias("l_key"), F.lit(True).alias("lost"))
    joined = base.join(lost, F.col("_k1").eqNullSafe(F.col("l_host")) & (F.col("_k2") == F.col("l_key")), "left")
    return joined.select(
        F.col("_k0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("lost").isNull()).alias("kept"),
    )


def keep(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that pass the base rules and aren't depleted, with all their columns."""
    names = docs.columns
    base = base_statistics(docs, text_col=text_col, keep=[*[F.col(f"`{c}`") for c in names], _text_key(_text(text_col))])
    host, key = F.col(f"_k{names.index(host_col)}"), F.col(f"_k{len(names)}")
    lost = depleted(docs, text_col=text_col, host_col=host_col).select(F.col("host").alias("l_host"), F.col("text_key").alias("l_key"))
    left = base.where(~F.col("base_failed")).join(lost, host.eqNullSafe(F.col("l_host")) & (key == F.col("l_key")), "left_anti")
    return left.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(names)])
