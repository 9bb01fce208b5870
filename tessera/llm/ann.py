"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are indexed once, with as many of their smallest ids as a result can hold, so a vector that
very many rows share costs one node. Distinct vectors are dealt into shards of about SHARD: first by bands of
their norms, a quarter of an octave wide, then by a hash. In a shard, vectors get one more component that makes
their norms equal, so that the largest inner product is the smallest distance; within a band that component is
small, so few long vectors don't push all others together. Nodes are inserted in batches: greedy beam searches
propose neighbours, relaxed distance pruning keeps diverse edges, and reverse edges are pruned likewise.

Each shard measures itself: a bounded sample of its vectors is searched by beams of growing width and by brute
force, and the shard keeps the first beam whose recall reaches RECALL. A shard where none does (vectors without any
structure) is scanned instead. The index is a table. Queries are sent to the shards, each of which is read once for
a block of QUERIES of them; what a shard finds is scored again in double precision on the original vectors, and the
best of all shards are ranked.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do
rows without an id; vectors meet those of their own length only. Rows that repeat an id and its vector count
once; an id of several vectors stands at its best. Ties go to the smaller id. With fewer candidates than k all are
returned; an empty table, or no queries, gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Distinct vectors of a shard, queries that search it one after the other in a task.
SHARD, QUERIES = 8192, 65_536
#: Edges of a node, beam when building, relaxation of the pruning, nodes inserted together.
DEGREE, BUILD_BEAM, RELAX, BATCH = 32, 64, 1.2, 256
#: Beams that a shard tries, recall of its own sample that one must reach, vectors of that sample.
BEAMS, RECALL, SAMPLE = (64, 128, 256, 512), 0.96, 64
#: Candidates whose edges are followed at once, queries that are searched at once.
WIDE, TOGETHER = 4, 256
#: Bands of norms for each doubling, parts of the table of shards.
BANDS, SALTS = 4, 16


def _usable(vector: str):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _beam(data, graph, entry: int, queries, beam: int):
    """ids and similarities (descending, -1 where there are none) of the best nodes found for each query, in lockstep."""
    import numpy as np

    b, n = len(queries), len(data)
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, "i4")
    sims = np.full((b, beam), -np.inf, "f4")
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids[:, 0], sims[:, 0], done[:, 0] = entry, queries @ data[entry], False
    seen[:, entry] = True
    while not done.all():
        at = np.argsort(done, axis=1, kind="stable")[:, :WIDE]
        u = np.where(done[rows, at], -1, ids[rows, at])
        done[rows, at] = True
        nb = graph[u].reshape(b, -1)
        nb = np.where(np.repeat(u < 0, graph.shape[1], axis=1), n, nb)
        nb[nb < 0] = n
        nb.sort(axis=1)
        new = ~seen[rows, nb]
        new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        seen[rows, nb] = True
        k, j = np.nonzero(new)
        found = np.full(nb.shape, -np.inf, "f4")
        found[k, j] = np.einsum("ij,ij->i", data[nb[k, j]], queries[k])
        sims = np.concatenate([sims, found], axis=1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        best = best[rows, np.argsort(-sims[rows, best], axis=1, kind="stable")]
        ids = np.concatenate([ids, nb.astype("i4")], axis=1)[rows, best]
        done = np.concatenate([done, ~new], axis=1)[rows, best]
        sims = sims[rows, best]
        none = np.isneginf(sims)
        ids[none], done[none] = -1, True
    return ids, sims


def _pruned(data, norm: float, nodes, candidates, degree: int):
    """The diverse edges of nodes: candidates (-1: none) from near to far, unless a kept one is much nearer to them."""
    import numpy as np

    valid = (candidates >= 0) & (candidates != nodes[:, None])
    order = np.sort(np.where(valid, candidates, -1), axis=1)
    valid = (order >= 0) & np.concatenate([np.ones((len(order), 1), bool), order[:, 1:] != order[:, :-1]], axis=1)
    c = np.where(valid, order, 0)
    far = np.where(valid, 2 * norm - 2 * np.einsum("bkd,bd->bk", data[c], data[nodes]), np.inf)
    near = np.argsort(far, axis=1, kind="stable")
    rows = np.arange(len(nodes))[:, None]
    c, far, alive = c[rows, near], far[rows, near], valid[rows, near]
    x = data[c]
    between = (2 * norm - 2 * np.matmul(x, x.transpose(0, 2, 1))) * RELAX**2
    edges, count = np.full((len(nodes), degree), -1, "i4"), np.zeros(len(nodes), "i8")
    for k in range(c.shape[1]):
        take = np.flatnonzero(alive[:, k] & (count < degree))
        if len(take):
            edges[take, count[take]] = c[take, k]
            count[take] += 1
            alive[take] &= between[take, k] > far[take]
    return edges


def _levelled(vectors):
    """The vectors (float32, scaled) with one more component that makes their norms equal, and the square of that norm."""
    import numpy as np

    x = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", x, x)
    norm = float(squares.max())
    return np.concatenate([x, np.sqrt(np.maximum(norm - squares, 0))[:, None]], axis=1).astype("f4"), norm


def _padded(queries):
    """Queries (float32, scaled) with a zero for the added component."""
    import numpy as np

    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype("f4")


def calibrated(vectors, data, graph, entry: int, k: int, seed: int = 13) -> int:
    """The least beam that finds RECALL of the k best of the shard's own sample; 0 if none does."""
    import numpy as np

    n = len(vectors)
    some = np.sort(np.random.default_rng(seed).permutation(n)[:SAMPLE])
    k = min(k + 1, n)
    scores = vectors[some] @ vectors.T
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    for beam in BEAMS:
        found, _ = _beam(data, graph, entry, _padded(vectors[some]), max(beam, k))
        hit = (np.take_along_axis(scores, np.maximum(found, 0), axis=1) >= least[:, None]) & (found >= 0)
        if np.minimum(hit.sum(axis=1), k).sum() >= RECALL * k * len(some):
            return beam
    return 0


def build_graph(vectors, seed: int = 11):
    """(data with the added component, graph, entry node) over the rows of vectors (float64)."""
    import numpy as np

    data, norm = _levelled(vectors)
    n = len(data)
    graph = np.full((n, DEGREE), -1, "i4")
    order = np.random.default_rng(seed).permutation(n)
    entry = int(order[0])
    start = 1
    while start < n:
        batch = order[start : start + min(BATCH, max(1, start))]
        found, _ = _beam(data, graph, entry, data[batch], BUILD_BEAM)
        mates = data[batch] @ data[batch].T
        k = min(16, len(batch))
        near = batch[np.argpartition(-mates, k - 1, axis=1)[:, :k]].astype("i4")
        graph[batch] = _pruned(data, norm, batch, np.concatenate([found, near], axis=1), DEGREE)
        source = np.repeat(batch, DEGREE)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        to, first, many = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(to), 512):
            t, f, m = to[part : part + 512], first[part : part + 512], many[part : part + 512]
            more = np.full((len(t), int(m.max())), -1, "i4")
            row = np.repeat(np.arange(len(t)), m)
            more[row, np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)] = source[np.repeat(f, m) + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)]
            both = np.sort(np.concatenate([graph[t], more], axis=1), axis=1)[:, ::-1]
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = np.sort(both, axis=1)[:, ::-1]
            full = (both >= 0).sum(axis=1) > DEGREE
            graph[t[~full]] = both[~full, :DEGREE]
            if full.any():
                width = int((both[full] >= 0).sum(axis=1).max())
                graph[t[full]] = _pruned(data, norm, t[full], both[full, :width], DEGREE)
        start += len(batch)
    return data, graph, entry


def distinct_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, k: int) -> DataFrame:
    """vector and ids: the k + 1 smallest ids that have it; no result needs more of them."""
    v = vectors.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), _numbers(vector_col).alias("vector"))
    #: The limit of the rank is applied before the shuffle too, so a vector of very many rows is cut where they are.
    ranked = v.withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _numbers(vector_col: str) -> Column:
    """The vector in double precision; a float's value stays what it is."""
    return F.col(vector_col).cast("array<double>")


def _banded(d: DataFrame) -> DataFrame:
    """d with width and the band of its vector's norm, whose middles are powers; the largest component is worked out before the lambda."""
    d = d.withColumn("most", F.array_max(F.transform("vector", F.abs)))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x / F.col("most")) * (x / F.col("most")))
    return d.select(F.size("vector").alias("width"), F.floor(BANDS * (F.log2("most") + F.log2(squares) / 2) + 0.5).cast("int").alias("band"), "vector", "ids")


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """The index as a table: width, band, shard, pos, vector, ids, edges, and the shard's entry and beam at its first row."""
    d = distinct_vectors(vectors, id_col=id_col, vector_col=vector_col, k=k)
    d = materialize(_banded(d), "vectors")
    #: A row for each length and band, as a table, so that Spark knows its size.
    shards = materialize(d.groupBy("width", "band").agg(F.ceil(F.count("*") / SHARD).alias("shards")), "bands")
    d = d.join(shards, ["width", "band"]).select("width", "band", F.pmod(F.xxhash64("vector"), "shards").cast("int").alias("shard"), "vector", "ids")

    def build(group):
        import numpy as np

        group = group.sort_values("ids", key=lambda s: s.map(lambda x: x[0]), kind="stable", ignore_index=True)
        raw = np.stack(group["vector"].to_numpy()).astype("f8")
        data, graph, entry = build_graph(raw)
        beam = calibrated(raw / np.abs(raw).max(), data, graph, entry, k)
        return group.assign(pos=np.arange(len(group), dtype="i4"), edges=list(graph), entry=np.int32(entry), beam=np.int32(beam))[[c.split()[0] for c in _INDEX.split(", ")]]

    return materialize(d.groupBy("width", "band", "shard").applyInPandas(build, _INDEX), "index")


_INDEX = "width int, band int, shard int, pos int, vector array<double>, ids array<long>, edges array<int>, entry int, beam int"


class _Shard:
    """The nodes of a shard, in memory, and the search of a block of queries in them."""

    def __init__(self, rows: list[tuple], k: int, beam: int | None) -> None:
        import numpy as np

        self.raw = np.array([r[0] for r in rows], "f8")
        self.ids = [r[1] for r in rows]
        self.graph = np.array([r[2] for r in rows], "i4")
        self.entry, own = rows[0][3], rows[0][4]
        self.k, self.beam = k, own if beam is None or not own else max(own, beam)
        self.data, _ = _levelled(self.raw)

    def best(self, names: list[int], vectors) -> list[tuple[int, int, float]]:
        import numpy as np

        if self.beam:
            near, _ = _beam(self.data, self.graph, self.entry, _padded(vectors), max(self.beam, self.k))
        else:
            #: Without structure: the exact best nodes, and one more for the query's own.
            most = min(self.k + 1, len(self.raw))
            near = np.argpartition(-(vectors @ self.raw.T), most - 1, axis=1)[:, :most]
        out = []
        for name, v, at in zip(names, vectors, near, strict=True):
            at = at[at >= 0]
            scores = (self.raw[at] * v).sum(axis=1)
            seen, left = set(), self.k
            for s, i in sorted((-s, i) for a, s in zip(at.tolist(), scores.tolist(), strict=True) for i in self.ids[a]):
                if i != name and i not in seen:
                    seen.add(i)
                    out.append((name, i, -s))
                    left -= 1
                    if not left:
                        break
        return out


def search(index: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the index found for each query, but the query's own. beam: the least to use."""
    q = queries.where(F.col(id_col).isNotNull() & _usable(vector_col))
    q = materialize(q.select(F.col(id_col).cast("long").alias("query_id"), _numbers(vector_col).alias("vector")).dropDuplicates(["query_id", "vector"]), "queries")
    blocks = max(1, -(-q.count() // QUERIES))
    #: One row for each shard; each query goes to every shard of its length. Salts spread a length where the table is too large to be sent to all.
    shards = materialize(index.where("pos = 0").select("width", "band", "shard", F.pmod(F.xxhash64("band", "shard"), F.lit(SALTS)).alias("salt")), "shards")
    q = q.withColumn("width", F.size("vector")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = q.join(shards, ["width", "salt"]).select("width", "band", "shard", "block", F.lit(1).alias("kind"), F.lit(0).alias("pos"), "vector", F.array("query_id").alias("ids"), F.array().cast("array<int>").alias("edges"), F.lit(0).alias("entry"), F.lit(0).alias("beam"))
    nodes = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    nodes = nodes.select("width", "band", "shard", "block", F.lit(0).alias("kind"), "pos", "vector", "ids", "edges", "entry", "beam")

    def find(batches):
        import numpy as np
        import pyarrow as pa

        shard, rows, held = None, [], None

        def flushed(out):
            names, found, scores = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(start, TOGETHER)
                key = list(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
                kind, vector, ids, edges, entry, beams = (b.column(c).to_pylist() for c in (4, 6, 7, 8, 9, 10))
                at = 0
                while at < len(key):
                    if key[at] != shard:
                        shard, rows, held = key[at], [], None
                    end = at
                    while end < len(key) and key[end] == shard and kind[end] == kind[at]:
                        end += 1
                    if not kind[at]:
                        rows += list(zip(vector[at:end], ids[at:end], edges[at:end], entry[at:end], beams[at:end], strict=True))
                    elif rows or held:
                        if held is None:
                            held, rows = _Shard(rows, k, beam), []
                        yield flushed(held.best([x[0] for x in ids[at:end]], np.array(vector[at:end], "f8")))
                    at = end

    keys = ["width", "band", "shard", "block"]
    dealt = nodes.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "pos")
    found = dealt.mapInArrow(find, "query_id long, vec_id long, score double")
    #: The shards' results have at most k rows for each query and shard; a query's are ranked after the best of each id.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
