"""Homomorphic multiset hashes of documents, by DataFrame functions only.

A paragraph (what stands between line feeds, as it is) has units: itself, and each run of SHINGLE of its words.
A unit is hashed to LANES bits, the vector of a paragraph is the sum of its units' bits in each lane, and that of a
text the sum over its paragraphs, modulo 2^BITS. So the order of paragraphs doesn't matter, equal multisets have
equal fingerprints, and paragraphs are inserted by plus() and deleted by minus() without the rest of the text.

A fingerprint is an array: the number of units, then LANES sums, three in a long with a guard bit each, so that
fingerprints are added a long at a time. As bits stand for +1 and -1, the inner product of two fingerprints estimates
how many units they share; likeness() is twice that over the sum of their squares, between 0 and 1.

neighbours() edits each text at its end with the start of the next one: the paragraphs before the edit keep their
sums, those after it are deleted, the new ones inserted. The next document is found in blocks of a range
partitioning, whose edges are one row a block.

Defined results: a null text is empty and has one empty paragraph. Null ids come last, equal ids follow in the
order of their texts' MD5, and rows equal in both follow each other. A single document is its own next one. Repeated
rows and null ids keep a row each. An empty table gives an empty result. Other columns aren't read. Two texts without any unit
in common have a likeness near 0: its standard deviation is the root of 1 over LANES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, words_of

#: Words of a shingle.
SHINGLE = 3
#: Bits of a lane's sum, bits from one lane to the next, lanes in a long, hashes of a unit; lanes of a fingerprint.
BITS, STEP, FIELDS, HASHES = 20, 21, 3, 2
LANES = STEP * FIELDS * HASHES
LONGS = STEP * HASHES
_ONES = sum(1 << (STEP * f) for f in range(FIELDS))
#: Paragraphs and units of a paragraph that are summed together: their product is no more than a field holds.
PARAGRAPHS, UNITS = 8, 12
#: Equal rows that one row stands for on the way.
RUN = 4096


def units_of(paragraph: Column) -> Column:
    """array<bigint>: hashes of the paragraph as it is and of its shingles (fewer words: all of them; none: no shingle)."""
    hashed = F.transform(words_of(paragraph), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    #: Bound once as the lambda's argument, so that the words aren't hashed again for each use.
    both = F.transform(F.array(hashed), shingles)
    return F.concat(F.array(F.xxhash64(F.lit("paragraph"), paragraph)), F.flatten(both))


def paragraphs_of(text: Column) -> Column:
    """array<string> of what stands between line feeds."""
    return F.split(text, "\n")


def _bits(unit: Column) -> list[Column]:
    """The bits of a unit, FIELDS of them in a long."""
    hashes = [F.xxhash64(unit, F.lit(k + 1).cast("long")) for k in range(HASHES)]
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES)) for h in hashes for k in range(STEP)]


def _sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp, for blocks of the paragraphs of each key. parts: keys, paragraphs (array<string>)."""
    p = parts.select(*keys, F.posexplode("paragraphs").alias("p", "paragraph"))
    u = p.select(*keys, F.shiftright("p", PARAGRAPHS).alias("p"), F.posexplode(units_of(F.col("paragraph"))).alias("u", "unit"))
    u = u.withColumn("u", F.shiftright("u", UNITS))
    sums = u.groupBy(*keys, "p", "u").agg(F.count("*").alias("n"), *[F.sum(b).alias(f"s{k}") for k, b in enumerate(_bits(F.col("unit")))])
    return sums.select(*keys, F.array("n", *[_lowest(F.col(f"s{k}")) for k in range(LONGS)]).alias("fp"))


def _lowest(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_ONES * ((1 << BITS) - 1)))


def zero() -> Column:
    """The fingerprint of nothing."""
    return F.array_repeat(F.lit(0).cast("long"), LONGS + 1)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together: paragraphs inserted."""
    return _each(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a without b: paragraphs deleted."""
    return _each(a, b, lambda x, y: x + (F.lit(_ONES << BITS) - y), lambda x, y: x - y)


def _each(a: Column, b: Column, lanes, count=None) -> Column:
    """lanes on all longs but the first, which holds the number of units; no field runs over into the next."""
    first = (count or lanes)(F.get(a, 0), F.get(b, 0))
    rest = F.zip_with(F.slice(a, 2, LONGS), F.slice(b, 2, LONGS), lambda x, y: _lowest(lanes(x, y)))
    return F.concat(F.array(first), rest)


def _total(prints: Column) -> Column:
    return F.aggregate(prints, zero(), plus)


def of_texts(docs: DataFrame, keys: list[str], *, text_col: str = "text") -> DataFrame:
    """keys and fp, the fingerprint of all texts of a key together."""
    parts = docs.select(*keys, paragraphs_of(F.coalesce(F.col(text_col), F.lit(""))).alias("paragraphs"))
    return _sums(parts, keys).groupBy(*keys).agg(_total(F.collect_list("fp")).alias("fp"))


def lanes_of(fp: Column) -> Column:
    """array<bigint>: for each lane the units with the bit less those without it."""
    top = 1 << (BITS - 1)

    def signed(x: Column) -> Column:
        #: Less the number of units, modulo the lane's power, around 0.
        return (2 * x - F.get(fp, 0) + top).bitwiseAND(F.lit(2 * top - 1)) - top

    fields = F.transform(F.slice(fp, 2, LONGS), lambda w: F.array(*[F.shiftrightunsigned(w, STEP * f).bitwiseAND(F.lit(2 * top - 1)) for f in range(FIELDS)]))
    return F.transform(F.flatten(fields), signed)


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(same: Column, a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of lanes; 1 where the fingerprints are the same."""
    both = (_product(a, a) + _product(b, b)).cast("double")
    found = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(2.0 * _product(a, b), both), F.lit(0.0))))
    return F.when(same, F.lit(1.0)).otherwise(found)


def text_of(fp: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _key(id_col: str, text: Column) -> Column:
    name = F.col(id_col)
    return F.unhex(F.md5(F.concat(F.md5(text), F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name.cast("string"))))))


def _order(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """key, id, n_chars, rows, next_key, for_key and need of each kind of row: its follower, and whom it gives how many characters."""
    kinds = docs.select(_key(id_col, text).alias("key"), F.col(id_col).alias("id"), F.md5(text).alias("raw"), F.char_length(text).cast("long").alias("n_chars"))
    kinds = materialize(kinds.groupBy("key", "id", "raw", "n_chars").agg(F.count("*").alias("rows")), "kinds")
    place = [F.col("id").isNull(), F.col("id"), F.col("raw")]
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = materialize(kinds.repartitionByRange(blocks, *place).withColumn("block", F.spark_partition_id()), "ordered")
    edges = kinds.groupBy("block").agg(F.min(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(place)], "key")).alias("first")).select("block", F.col("first.key").alias("first"))
    #: One row for each block.
    row = Window.orderBy("block")
    edges = edges.select("block", F.coalesce(F.lead("first").over(row), F.first("first").over(row)).alias("after"))
    within = Window.partitionBy("block").orderBy(*place)
    linked = kinds.withColumn("next_in", F.lead("key").over(within)).join(edges, "block")
    linked = materialize(linked.select("key", "id", "n_chars", "rows", F.coalesce("next_in", "after").alias("next_key")), "linked")
    needs = linked.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.expr("n_chars div 4").alias("need"))
    return materialize(linked.join(needs, "key"), "neighbours")


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last quarter (floor of n_chars / 4) replaced by as many first characters of the next document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = _order(docs, id_col, text)
    repeated = not order.where("rows > 1").isEmpty()
    texts = docs.select(_key(id_col, text).alias("key"), text.alias("text"))
    if repeated:  # one row of each kind
        texts = texts.distinct()
    sent = texts.join(order, "key")
    heads = sent.select(F.col("for_key").alias("key"), F.substr("text", F.lit(1), F.col("need").cast("int")).alias("head"))
    d = sent.drop("for_key", "need").join(heads, "key").withColumn("cut", F.expr("n_chars div 4").cast("int"))
    d = d.withColumn("again", F.lit(False))
    if repeated:  # of equal rows all but the last are followed by themselves
        once = F.struct("head", F.lit(1).cast("long").alias("rows"), "next_key", F.lit(False).alias("again"))
        more = F.struct(F.substr("text", F.lit(1), F.col("cut")).alias("head"), (F.col("rows") - 1).alias("rows"), F.col("key").alias("next_key"), F.lit(True).alias("again"))
        d = d.select("key", "id", "n_chars", "text", "cut", F.inline(F.when(F.col("rows") > 1, F.array(once, more)).otherwise(F.array(once))))
    d = d.withColumn("left", F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")))
    d = d.withColumn("open", F.substring_index("left", "\n", -1))
    d = d.withColumn("whole", F.char_length("left") - F.char_length("open"))
    before = F.when(F.col("whole") > 0, paragraphs_of(F.substr("text", F.lit(1), F.col("whole") - 1))).otherwise(F.array().cast("array<string>"))
    after = paragraphs_of(F.substr("text", F.col("whole") + 1, F.col("n_chars").cast("int")))
    edited = F.sha2(F.concat("left", "head").cast("binary"), 256)
    keys = ["key", "next_key", "again", "id", "n_chars", "rows", "edited_sha256"]
    kept, gone, new = (F.struct(F.lit(k).alias("part"), c.alias("paragraphs")) for k, c in enumerate((before, after, paragraphs_of(F.concat("open", "head")))))
    parts = d.withColumn("edited_sha256", edited).select(*keys, F.inline(F.array(kept, gone, new)))
    #: The joins have put a key's rows together: what follows needs no shuffle.
    sums = _sums(parts, [*keys, "part"]).groupBy(*keys).agg(F.collect_list(F.struct("part", "fp")).alias("sums"))
    of = lambda *part: _total(F.transform(F.filter("sums", lambda s: s.part.isin(*part)), lambda s: s.fp))
    sums = sums.select(*keys, of(0).alias("stays"), of(1).alias("gone"), of(2).alias("new"))
    sums = sums.select(*keys, plus(F.col("stays"), F.col("gone")).alias("fp"), F.col("gone"), F.col("new"))
    prints = materialize(sums.select(*keys, "fp", plus(minus(F.col("fp"), F.col("gone")), F.col("new")).alias("edited")), "fingerprints")
    following = prints.where("NOT again").select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp"))
    out = prints.join(following, "next_key")
    if repeated:
        out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN).cast("long"))))
        if not order.where(F.col("rows") > RUN).isEmpty():
            out = out.repartition("key", "run")
        out = out.withColumn("row", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("rows")) - 1)))
    out = out.select(*keys, "fp", "edited", "next_fp", lanes_of(F.col("fp")).alias("a"), lanes_of(F.col("edited")).alias("b"), lanes_of(F.col("next_fp")).alias("c"))
    near = lambda other, lanes: likeness(F.col("fp") == F.col(other), F.col("a"), F.col(lanes))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        near("edited", "b").alias("near_edited"), near("next_fp", "c").alias("near_next"),
    )
