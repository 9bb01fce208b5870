"""Multiset fingerprints against a plain version, and what addition and deletion of paragraphs must give."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def chain(values, seed=42):
    for v in values:
        seed = h(v, seed)
    return seed


def plain(text):
    """Number of units, and of the units with each lane's bit."""
    total = np.zeros(1 + fp.LANES, object)
    for p in (text or "").split("\n"):
        w = [h(x) for x in WORD.findall(p)]
        units = [chain(["paragraph", p])] + [chain(w[i : i + 3]) for i in range(len(w) - 2)] + ([chain(w)] if 0 < len(w) < 3 else [])
        for u in units:
            hashes = [chain([u, k + 1]) for k in range(fp.HASHES)]
            total += [1] + [x >> (k + fp.STEP * f) & 1 for x in hashes for k in range(fp.STEP) for f in range(fp.FIELDS)]
    return [int(x) if k == 0 else int(x) % (1 << fp.BITS) for k, x in enumerate(total)]


def packed(total):
    longs = [sum(total[1 + fp.FIELDS * k + f] << (fp.STEP * f) for f in range(fp.FIELDS)) for k in range(fp.LONGS)]
    return "".join(f"{x:016x}" for x in [total[0], *longs])


def alike(a, b):
    if a == b:
        return 1.0
    top = 1 << (fp.BITS - 1)
    x, y = ([(2 * s - t[0] + top) % (2 * top) - top for s in t[1:]] for t in (a, b))
    norm = sum(v * v for v in x) + sum(v * v for v in y)
    return min(1.0, max(0.0, 2.0 * sum(v * w for v, w in zip(x, y, strict=True)) / norm)) if norm else 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out, known = [], {}
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (known.setdefault(t, plain(t)) if t in known else known.setdefault(t, plain(t)) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(a), packed(b), round(alike(a, b), 12), round(alike(a, c), 12)))
    return sorted(out, key=str)


def got(docs):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in fp.neighbours(docs).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcé😀", k=draw.randint(1, 5))) for _ in range(200)]
    out = [(k, "\n".join(" ".join(draw.choices(words, k=draw.randint(0, 15))) for _ in range(draw.randint(1, 9))), "x") for k in range(60)]
    odd = [None, "", " ", "\n", "\n\n\n", "one", "two words", "\t a  b\x0bc ", "abc", "abcd", "abcd\n", "x " * 6000, "line\n" * 700, "a\x00b"]
    out += [(100 + k, t, None) for k, t in enumerate(odd)]
    out += [(7, "other text of an equal id", "x"), (8, out[8][1], "x"), (8, out[8][1], "x"), (None, "no id", None), (None, "no id", None), (None, None, None), (1 << 60, "far", "x")]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours_match_plain_version(spark, rows, partitions):
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("fp", F.lit(1)).withColumn("raw", F.lit("clash")).repartition(partitions)
    assert got(docs) == expected(rows)


@pytest.mark.parametrize("some", [[], [(1, "alone here\nand now")], [(5, None)], [(1, "same")] * 3, [(None, "a b c d e f g h")] * 5])
def test_few_rows(spark, some):
    assert got(spark.createDataFrame(some, "doc_id long, text string")) == expected(some)


def test_ids_of_other_types(spark):
    some = [("b", "x y z a b c d e f"), ("a", "other text"), ("a2", "third text of all")]
    assert got(spark.createDataFrame(some, "doc_id string, text string")) == expected([(i, t) for i, t in some])


def test_small_blocks_of_paragraphs_and_many_equal_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(fp, "PARAGRAPHS", 1)
    monkeypatch.setattr(fp, "UNITS", 2)
    monkeypatch.setattr(fp, "RUN", 2)
    more = rows + [(8, rows[8][1], "x")] * 9
    assert got(spark.createDataFrame(more, "doc_id long, text string, key string")) == expected(more)


def test_paragraphs_are_inserted_and_deleted_in_any_order(spark):
    a, b, c = "first of all words", "second words stand here\nthird line", "x y z"
    texts = {"whole": f"{a}\n{b}\n{c}", "turned": f"{c}\n{a}\n{b}", "a": a, "b": b, "c": c, "ac": f"{a}\n{c}", "none": "first of all word"}
    d = fp.of_texts(spark.createDataFrame(list(texts.items()), "name string, text string"), ["name"])
    p = d.groupBy().pivot("name", list(texts)).agg(F.first("fp"))
    at = F.col
    total = fp.plus(fp.plus(at("b"), at("a")), at("c"))
    row = p.select(at("whole") == at("turned"), total == at("whole"), fp.minus(at("whole"), at("b")) == at("ac"), fp.minus(fp.minus(at("ac"), at("c")), at("a")) == fp.zero(), at("a") != at("none")).first()
    assert all(row)


def test_sums_wrap_at_the_power(spark):
    high = F.array(F.lit(5).cast("long"), *[F.lit(fp._ONES * ((1 << fp.BITS) - 1))] * fp.LONGS)
    one = F.array(F.lit(1).cast("long"), *[F.lit(fp._ONES)] * fp.LONGS)
    row = spark.range(1).select(fp.plus(high, one).alias("up"), fp.minus(fp.plus(high, one), one).alias("back"), high.alias("high"), fp.plus(high, high).alias("twice")).first()
    assert row.up == [6] + [0] * fp.LONGS and row.back == row.high
    assert row.twice == [10] + [fp._ONES * ((1 << fp.BITS) - 2)] * fp.LONGS


def test_likeness_follows_the_shared_part(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 2000")
    out = fp.neighbours(rows).selectExpr("avg(near_edited) e", "avg(near_next) n", "count_if(near_edited > near_next) / count(*) better").first()
    assert 0.7 < out.e < 0.8 and out.n < 0.06 and out.better > 0.99
