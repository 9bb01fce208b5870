"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more, verified exactly.

Fingerprints of 64 bits can't find such links alone: at a similarity of 0.8 they differ in 10 bits on average and
often in 16, a distance at which about one in 30,000 pairs of unrelated texts lies too. So the near-duplicates of
tessera.llm.simhash take their candidates from two sources: fingerprints within a few bits, and bands, which are
ROWS minimum hashes of BANDS * ROWS. Two texts of similarity 0.8 share none of the bands with a probability of
(1 - 0.8 ** 3) ** 20 = 6e-7, more similar ones with less.

Each candidate pair of fingerprints, and each text with the least and the greatest of its bands, is verified first;
that alone joins a large group of near copies in linear time. Only bands whose texts are then in several components
are compared in full, in blocks of numpy: intersections of all sets of a block are one matrix product over the
shingles that occur twice in it, and only a spanning forest of its links goes on. Bands of over BLOCK texts or
WEIGHT shingles are dealt out in blocks, each pair of which meets once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components
from tessera.llm.common import materialize

#: Words of a shingle.
SHINGLE = 5
#: Minimum hashes of a band, bands.
ROWS, BANDS = 3, 20
#: Texts and shingles of a block of a band; columns of the matrix that intersections are taken from at once.
BLOCK, WEIGHT, COLUMNS = 512, 1_000_000, 2048
#: Buckets that are read together.
READ_ROWS = 2000


def _hashes(texts: DataFrame, *more: str) -> DataFrame:
    """k, w (the hashes of the words) and more columns of every k, norm (words with one blank between them)."""
    words = F.when(F.col("norm") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("norm", " "), lambda x: F.xxhash64(x)))
    return texts.select("k", words.alias("w"), *more)


def shingled(words):
    """The shingle hashes (uint64) of one text's word hashes, repeats included; a shorter text is one shingle."""
    import numpy as np

    factor = np.uint64(0x9E3779B97F4A7C15)
    n = len(words)
    if not n:
        return words
    size = min(SHINGLE, n)
    h = np.full(n - size + 1, size, "u8")
    for k in range(size):
        h = (h ^ words[k : n - size + 1 + k]) * factor
        h ^= h >> np.uint64(32)
    return h


def sketches(texts: DataFrame) -> DataFrame:
    """k, n (distinct shingles), fp (fingerprint), bands and row of every k, norm, row; copies are not combined."""

    def sketch(batches):
        import numpy as np
        import pyarrow as pa

        numbers = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS + ROWS), "u8")
        flip, factor = numbers[0, : BANDS * ROWS, None], numbers[1, : BANDS * ROWS, None] | np.uint64(1)
        mix, of = numbers[1, BANDS * ROWS :] | np.uint64(1), numbers[0, :BANDS]
        for b in batches:
            at, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy().view("u8")
            least, size, fp = np.full((b.num_rows, BANDS * ROWS), np.iinfo("u8").max, "u8"), np.zeros(b.num_rows, "i8"), np.zeros(b.num_rows, "u8")
            for i in range(b.num_rows):
                every = shingled(flat[at[i] : at[i + 1]])
                ones = np.zeros(64, "i8")
                for part in range(0, len(every), 4096):
                    ones += np.unpackbits(every[part : part + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
                fp[i] = np.packbits(2 * ones > len(every), bitorder="little").view("u8")[0]
                own = np.unique(every)
                size[i] = len(own)
                for part in range(0, len(own), 2048):
                    least[i] = np.minimum(least[i], ((own[part : part + 2048] ^ flip) * factor).min(axis=1))
            rows = (least >> np.uint64(32)).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(of, rows.shape[:2]).copy()
            for r in range(ROWS):
                key = (key ^ rows[:, :, r]) * mix[r]
                key ^= key >> np.uint64(29)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS, dtype="i4")), pa.array(key.ravel().view("i8")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(fp.view("i8")), bands, b.column(2)], names=["k", "n", "fp", "bands", "row"])

    return _hashes(texts, "row").mapInArrow(sketch, "k binary, n bigint, fp bigint, bands array<bigint>, row bigint")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """k and h, the sorted distinct shingle hashes, of every k, norm."""

    def sets(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy().view("u8")
            for start in range(0, b.num_rows, 500):
                own = [np.unique(shingled(flat[at[i] : at[i + 1]])).view("i8") for i in range(start, min(start + 500, b.num_rows))]
                ends = np.cumsum([0, *map(len, own)]).astype("i4")
                h = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(own)), h], names=["k", "h"])

    return _hashes(texts).mapInArrow(sets, "k binary, h array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose sets have a similarity of 4/5 at least: s / (a + b - s) >= 4 / 5."""
    one, two = sets.select(F.col("k").alias("v"), F.col("h").alias("hv")), sets.select(F.col("k").alias("u"), F.col("h").alias("hu"))
    both = pairs.join(one, "v").join(two, "u")
    return both.where(9 * F.size(F.array_intersect("hu", "hv")) >= 4 * (F.size("hu") + F.size("hv"))).select("u", "v")


def _forest(sets, component) -> list[tuple[int, int]]:
    """Positions of links that join the components of the sets (sorted arrays) as far as their similarities do."""
    import numpy as np

    m = len(sets)
    names, c = np.unique(component, return_inverse=True)
    if len(names) < 2:
        return []
    size = np.array([len(x) for x in sets])
    found, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(m), size)
    twice = often > 1
    place = np.cumsum(twice) - 1
    keep = twice[column]
    row, column = of[keep], place[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    shared = np.zeros((m, m), "f4")
    for start in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        x = np.zeros((m, COLUMNS), "f4")
        x[row[a:b], column[a:b] - start] = 1
        shared += x @ x.T
    i, j = np.nonzero(np.triu(9 * shared >= 4 * (size[:, None] + size[None, :]), 1))
    other = c[i] != c[j]
    group, out = list(range(len(names))), []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for a, b in zip(i[other].tolist(), j[other].tolist()):
        x, y = root(c[a]), root(c[b])
        if x != y:
            group[x] = y
            out.append((a, b))
    return out


def _linked(batches):
    """u, v from rows bucket, k, c, h that are sorted by bucket."""
    import numpy as np
    import pyarrow as pa

    held: list = []

    def links(rows):
        if len(rows) < 2:
            return [], []
        found = _forest([h for _, _, h in rows], np.array([c for _, c, _ in rows], "O"))
        return [rows[a][0] for a, _ in found], [rows[b][0] for _, b in found]

    bucket = None
    for batch in batches:
        u, v = [], []
        for start in range(0, batch.num_rows, READ_ROWS):
            b = batch.slice(start, READ_ROWS)
            names, k, c, h = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)
            at, flat = h.offsets.to_numpy(), h.values.to_numpy()
            for i, name in enumerate(names):
                if name != bucket:
                    x, y = links(held)
                    u, v = u + x, v + y
                    bucket, held = name, []
                held.append((k[i], c[i], flat[at[i] : at[i + 1]].copy()))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
    u, v = links(held)
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def links(texts: DataFrame, sketched: DataFrame, near: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """u, v: verified links between the keys of texts (k, norm, row; copies repeat a key), enough to span every component.

    sketched: a row of sketches() for each key. near: u, v, further candidates. Words are read again by the row of a key, so
    a text of very many copies is read once. scratch gets the tables that may be released once the links are written.
    """
    bands = sketched.select(F.explode("bands").alias("b"), "k", "n").where("n > 0")
    ends = bands.groupBy("b").agg(F.min("k").alias("p"), F.max("k").alias("q")).where("p != q")
    shared = materialize(bands.join(ends, "b"), "shared")
    ended = shared.select(F.col("k").alias("v"), F.explode(F.array("p", "q")).alias("u")).unionByName(near).where("u != v")
    ended = materialize(ended.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "ended")
    members = shared.select("k").unionByName(near.select(F.explode(F.array("u", "v")).alias("k"))).distinct()
    own = texts.join(sketched.select("k", "row").join(members, "k", "left_semi").select("row"), "row", "left_semi")
    sets = materialize(shingle_sets(own), "sets")
    first = materialize(_verified(ended, sets), "links")
    stars = components.stars(first)
    named = shared.select("b", "k", "n").join(stars.select(F.col("u").alias("k"), F.col("v").alias("c")), "k", "left").withColumn("c", F.coalesce("c", "k"))
    named = materialize(named, "named")
    mixed = named.groupBy("b").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1 AND m > 2")
    #: Both texts of a band of two were its ends. A large band is dealt into blocks by a hash; each pair of blocks meets once.
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    z = named.join(mixed.select("b", blocks.alias("blocks")), "b").join(sets, "k")
    z = z.withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.concat_ws(",", "b", F.least("own", "other"), F.greatest("own", "other"))
    z = z.select(bucket.alias("bucket"), "k", "c", "h")
    scratch += [shared, ended, sets, first, stars, named]
    rest = z.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linked, "u binary, v binary")
    return first.unionByName(rest)
