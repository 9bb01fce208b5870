"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: the shingles are hashed in the JVM, bits are counted per document with Arrow. Linking works on
distinct fingerprints, so copies cost nothing. Counts of all pairs of bits over the corpus give the
correlations by which bits are grouped into partitions, and the candidate counts of each partition at each
threshold (a chain over its bits). Dynamic programming picks the thresholds t_i, whose sum must be
distance - partitions + 1, with the least estimated cost: two fingerprints within the distance then are
within t_i in some partition i, and -1 leaves a partition out. Every fingerprint is put under its own value
of each partition and probes the values within t_i; those that meet are verified in blocks of numpy, and
only a spanning forest of each bucket's links goes on. Buckets of more than HOT rows are split into blocks,
each pair of which is a bucket of its own. Components are those of the links.

similar_texts() and keep_one() are for near copies: there fingerprints of five-word shingles give candidates, which
are verified by the exact similarity of the sets; fingerprints that few bits separate find only some of the texts
of similarity 0.8, so the candidates of tessera.llm.jaccard come beside them.

Defined results: null, empty and blank texts have the fingerprint zero and are linked like any other; as near
copies they are copies of each other. Null ids keep their rows; a component without ids has a null component_id.
Repeated rows keep a row each. An empty table gives an empty result. Other columns, of any name, aren't read by
near_duplicates() and are passed on by keep_one(). keep_one() decides on rows, not on ids: of a group the row with
the smallest id stays, nulls last, then the one with the least digest of the text; a row repeated in id and text
stays once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components, jaccard
from tessera.llm.common import SPACE, ascii_lower, materialize, release, words_of

BITS = 64
#: Words of a shingle, differing bits of a link.
SHINGLE, DISTANCE = 3, 3
#: Rows of a bucket that are verified together; from here on a bucket is dealt out in blocks.
HOT = 4096
#: Rows of a bucket up to which its pairs are compared along the sorted table, several buckets at once.
FEW = 16
#: Cost of a row that is put under a key, in pairs compared.
ROW_COST = 50.0
#: Partitions that are tried.
PARTITIONS = range(2, 7)


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """id and fp (bigint) of every row: a bit is 1 if it is set in over half the hashes of the shingles."""
    w = F.col("_w")
    d = docs.select(F.col(id_col).alias("id"), words_of(ascii_lower(F.col(text_col))).alias("_w"))
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle)])))
    d = d.select("id", F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many).alias("h"))
    kind = docs.schema[id_col].dataType.simpleString()

    def vote(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            hashes = b.column(1)
            at, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            fp = np.zeros(b.num_rows, "u8")
            for k in range(b.num_rows):
                own = flat[at[k] : at[k + 1]]
                ones = np.zeros(BITS, "i8")
                for part in range(0, len(own), 8192):
                    ones += np.unpackbits(own[part : part + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
                fp[k] = np.packbits(2 * ones > len(own), bitorder="little").view("u8")[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("i8"))], names=["id", "fp"])

    return d.mapInArrow(vote, f"id {kind}, fp bigint")


def _bit_counts(fps: DataFrame):
    """The number of fingerprints, and in how many both of two bits are set (64 x 64); a fixed amount of numbers."""
    import numpy as np

    def count(batches):
        import pandas as pd

        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy().astype("i8").view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            both += x.T @ x
            n += len(x)
        yield pd.DataFrame({"k": range(BITS * BITS + 1), "n": [n, *both.astype("i8").ravel().tolist()]})

    rows = fps.select("fp").mapInPandas(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.k] = r.n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def _groups(correlation, m: int) -> list[list[int]]:
    """m partitions of nearly equal width: each takes the bit most correlated with the bits it has."""
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        pair = max(combinations(sorted(left), 2), key=lambda p: correlation[p]) if len(left) > 1 else tuple(left)
        group = list(pair)[:width]
        left -= set(group)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: correlation[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def _within(group: list[int], n: int, both, most: int) -> list[float]:
    """Estimated shares of pairs that differ in at most 0..most bits of the group, by a chain over its bits."""
    import numpy as np

    ones = np.diag(both) / n
    agree = ones**2 + (1 - ones) ** 2
    state = np.zeros((2, most + 2))  # [differs in the last bit, bits that differ so far]
    state[0, 0], state[1, 1] = agree[group[0]], 1 - agree[group[0]]
    for a, b in zip(group, group[1:]):
        p11 = both[a, b] / n
        p10, p01 = ones[a] - p11, ones[b] - p11
        same = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
        joint = np.array([[same, agree[a] - same], [agree[b] - same, 1 - agree[a] - agree[b] + same]]).clip(0)
        to = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
        new = np.zeros_like(state)
        new[0] = state[0] * to[0, 0] + state[1] * to[1, 0]
        new[1, 1:] = (state[0] * to[0, 1] + state[1] * to[1, 1])[:-1]
        state = new
    return np.cumsum(state.sum(axis=0))[: most + 1].tolist()


def plan(n: int, both, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, with the least estimated cost."""
    import numpy as np

    ones = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread)
    best = (float("inf"), [])
    for m in PARTITIONS:
        groups = _groups(correlation, m)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # thresholds so far, each plus 1, summed
        for g in groups:
            shares = _within(g, max(n, 1), both, distance)
            rows, new = 0.0, {}
            for t in range(-1, distance + 1):
                rows += 0 if t < 0 else float(np.prod([len(g) - k for k in range(t)]) / np.prod([k + 1 for k in range(t)]))
                cost = 0.0 if t < 0 else n * rows * ROW_COST + n * n / 2 * shares[t]
                for total, (c, ts) in reach.items():
                    key = total + t + 1
                    if key <= distance + 1 and (key not in new or c + cost < new[key][0]):
                        new[key] = c + cost, [*ts, t]
            reach = new
        if distance + 1 in reach and reach[distance + 1][0] < best[0]:
            best = reach[distance + 1][0], [(g, t) for g, t in zip(groups, reach[distance + 1][1], strict=True) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, fp, probe: every fingerprint under its own value of each partition, and under those within its threshold."""
    made = []
    for k, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in c) for size in range(t + 1) for c in combinations(bits, size)]
        made += [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(f))).alias("key"), F.lit(bool(f)).alias("probe")) for f in flips]
    return fps.select("fp", F.explode(F.array(*made)).alias("x")).select("x.part", "x.key", "fp", "x.probe")


def _forest(fp, probe, distance: int):
    """Positions of links that span the components of the links among fp; two probes aren't compared."""
    import numpy as np

    new, out_a, out_b = np.ones(len(fp), bool), [], []
    while new.any():
        queue = [int(np.argmax(new))]
        new[queue[0]] = False
        while queue:
            u = queue.pop()
            hit = new & (np.bitwise_count(fp ^ fp[u]) <= distance)
            if probe[u]:
                hit &= ~probe
            found = np.flatnonzero(hit)
            if len(found):
                new[found] = False
                out_a += [u] * len(found)
                out_b += found.tolist()
                queue += found.tolist()
    return out_a, out_b


def _verified(distance: int):
    """The links of rows sorted by bucket (its columns come first, then fp and probe)."""

    def run(batches):
        import numpy as np
        import pandas as pd

        def links(b):
            fp, probe = b["fp"].to_numpy().astype("i8").view("u8"), b["probe"].to_numpy().astype(bool)
            names = [c for c in b.columns if c not in ("fp", "probe")]
            new = np.zeros(len(b), bool)
            new[0] = True
            for c in names:
                x = b[c].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(b)))
            of = np.repeat(np.arange(len(starts)), sizes)
            one, two = [], []
            few = sizes[of] <= FEW
            for s in range(1, min(FEW, int(sizes.max(initial=1)))):
                k = np.flatnonzero(few[:-s] & (of[:-s] == of[s:]) & ~(probe[:-s] & probe[s:]))
                k = k[np.bitwise_count(fp[k] ^ fp[k + s]) <= distance]
                one.append(fp[k])
                two.append(fp[k + s])
            for g in np.flatnonzero(sizes > FEW):
                own = slice(starts[g], starts[g] + sizes[g])
                i, j = _forest(fp[own], probe[own], distance)
                one.append(fp[own][i])
                two.append(fp[own][j])
            one, two = np.concatenate([np.empty(0, "u8"), *one]).view("i8"), np.concatenate([np.empty(0, "u8"), *two]).view("i8")
            return pd.DataFrame({"u": one, "v": two})

        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            names = [c for c in b.columns if c not in ("fp", "probe")]
            last = (b[names] == b[names].iloc[-1]).all(axis=1).to_numpy()
            cut = len(b) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = b.iloc[cut:].reset_index(drop=True)
            if cut:
                yield links(b.iloc[:cut])
        if held is not None and len(held):
            yield links(held)

    return run


def links(fps: DataFrame, parts: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """u, v: links between distinct fingerprints, enough of them to span every component."""
    rows = probes(fps, parts)
    schema = "u bigint, v bigint"
    hot = materialize(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    if hot.isEmpty():
        return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInPandas(_verified(distance), schema)
    cold = rows.join(hot, ["part", "key"], "left_anti")
    found = cold.repartition("part", "key").sortWithinPartitions("part", "key").mapInPandas(_verified(distance), schema)
    #: A hot bucket is dealt into blocks by a hash; each pair of blocks meets once.
    dealt = rows.join(hot, ["part", "key"]).withColumn("blocks", F.ceil(F.col("n") / (HOT // 2)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "probe")
    bucket = ["part", "key", "low", "high"]
    return found.unionByName(dealt.repartition(*bucket).sortWithinPartitions(*bucket).mapInPandas(_verified(distance), schema))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """id, fp (bigint) and component_id, the smallest id that links reach, of every row."""
    d = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    fps = materialize(d.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    n, both = _bit_counts(fps)
    if n < 2:
        return d.join(fps, "fp").select(F.col("id").alias(id_col), "fp", F.col("least").alias("component_id"))
    stars = components.stars(links(fps.select("fp"), plan(n, both, distance), distance))
    rooted = fps.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    #: The members' ids are combined before the shuffle, so a large component is one row of each task; its root's own id joins once.
    members = rooted.where("root != fp").groupBy("root").agg(F.min("least").alias("others"))
    least = fps.join(members, F.col("fp") == F.col("root")).select("root", F.least("others", "least").alias("component_id"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return d.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _near_pairs(sketched: DataFrame, distance: int) -> DataFrame:
    """u, v: keys whose fingerprints are equal or linked, by way of the least key of each fingerprint."""
    fps = materialize(sketched.where("n > 0").groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("texts")), "distinct")
    equal = sketched.join(fps.where("texts > 1"), "fp").select(F.col("least").alias("u"), F.col("k").alias("v"))
    n, both = _bit_counts(fps)
    if n < 2:
        return equal
    linked = links(fps.select("fp"), plan(n, both, distance), distance).withColumnsRenamed({"u": "fu", "v": "fv"})
    one, two = fps.select(F.col("fp").alias("fu"), F.col("least").alias("u")), fps.select(F.col("fp").alias("fv"), F.col("least").alias("v"))
    return equal.unionByName(linked.join(one, "fu").join(two, "fv").select("u", "v"))


def similar_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """id, raw (digest of the text), k (digest of its lower-cased words) and root, equal for the rows of a group."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), f"[{SPACE}]+"), "")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("raw"), F.array_join(words, " ").alias("norm"))
    #: The text's words are cut once; what is read of the table again is its keys, or the words of a few rows.
    rows = materialize(rows.select("id", "raw", F.unhex(F.md5("norm")).alias("k"), "norm", F.monotonically_increasing_id().alias("row")), "words")
    texts = rows.select("k", "norm", "row")
    sketched = materialize(jaccard.sketches(texts).dropDuplicates(["k"]), "sketches")
    scratch = [sketched]
    found = components.stars(jaccard.links(texts, sketched, _near_pairs(sketched, distance), scratch))
    for table in scratch:
        release(table)
    named = rows.select("id", "raw", "k").join(found.select(F.col("u").alias("k"), F.col("v").alias("root")), "k", "left")
    return named.withColumn("root", F.coalesce("root", "k"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of docs of each group of texts that links of similarity 4/5 on five-word shingles join."""
    names = docs.columns
    found = similar_texts(docs, id_col=id_col, text_col=text_col, distance=distance)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw")).alias("x")).select("x.id", "x.raw")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    own, text = f"c{names.index(id_col)}", F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    rows = rows.withColumn("own", F.unhex(F.md5(text)))
    kept = rows.join(least, F.col(own).eqNullSafe(F.col("id")) & (F.col("own") == F.col("raw")), "left_semi").dropDuplicates([own, "own"])
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
