"""Whitening of vectors: components by one-sided Jacobi rotations of the R factor of all centred rows.

Entries become whole numbers, floor(SCALE * c) + SHIFT, so that their sums are exact and rows are centred without
rounding before the division: (n * x - S) / n. Each task compresses its centred rows to one R, a block at a time by QR
(TSQR); the tasks' factors meet in groups of FAN until one is left. Plane rotations make the columns of that R
orthogonal; the accumulated rotations are the components, the columns' lengths over the root of n the standard
deviations. A covariance matrix, which would square the condition, is never formed.

All tables on the way are as small as the dimensions of a vector, for each task. The fit (components up to COMPONENTS)
goes to the tasks with the function that whitens rows, in pieces of FIT_NUMBERS at most.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so are rows with an entry
of EXACT or more, which has no exact whole number as a double. Vectors are whitened with those of their own
length; empty ones have no components. A component without variance has whitened 0 and takes no part in
identity_error, which is 0 where none is left; explained is 0 where there is no variance at all. A deviation beyond a long
is null. Repeated rows and null ids keep a row each and count in the fit. An empty table gives an empty result. Other
columns aren't read. Of both signs of a component the one whose largest entry is positive is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Entries as whole numbers.
SCALE, SHIFT, EXACT = 1024, 100_000, float(1 << 43)
#: Components of the result.
COMPONENTS = 8
#: Factors that meet in one task; numbers of a block of rows, of all factors a task holds, and of a fit sent to tasks.
FAN, BLOCK_NUMBERS, HELD_NUMBERS, FIT_NUMBERS = 16, 1 << 20, 1 << 23, 1 << 22
#: Sweeps of rotations at most, and the cosine of two columns that counts as orthogonal.
SWEEPS, ORTHOGONAL = 60, 1e-15
#: Part of the largest standard deviation under which a component has no variance.
FLAT = 1e-13


def _usable(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= EXACT))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array of doubles) of the rows that take part."""
    v = F.col(vector_col)
    return vectors.where(_usable(v)).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vector"))


def _blocks(batch, at: int):
    """rows, x: places of rows of one length in an Arrow batch and their whole numbers, a bounded block at a time."""
    import numpy as np

    column = batch.column(at)
    offsets = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1]
    flat = column.values.to_numpy()
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        step = max(1, BLOCK_NUMBERS // max(d, 1))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            v = flat[offsets[part][:, None] + np.arange(d)]
            yield part, np.floor(SCALE * v).astype("i8") + SHIFT


def _exact(x):
    """Whole numbers that can be multiplied and summed without running over: int64 where that is certain, else Python's."""
    return x.astype(object)


def _sum(x):
    """Exact sums over the rows, as Python integers."""
    import numpy as np

    if not x.size or int(np.abs(x).max()) < (1 << 62) // len(x):
        return x.sum(axis=0).tolist()
    return _exact(x).sum(axis=0).tolist()


def sums(rows: DataFrame) -> list[tuple[int, int, list[int]]]:
    """width, n and the exact sum of each dimension, of all rows: one entry for each length of vectors."""

    def counted(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            for part, x in _blocks(b, 0):
                total = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                total[0] += len(part)
                total[1] = [p + q for p, q in zip(total[1], _sum(x), strict=True)]
        for d, (n, total) in held.items():
            out = [(d, n, k, str(s)) for k, s in enumerate([*total, 0])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["width", "n", "k", "s"])

    parts = rows.select("vector").mapInArrow(counted, "width long, n long, k long, s string")
    whole = parts.groupBy("width", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in whole.collect():
        found.setdefault(r.width, (r.n, {}))[1][r.k] = int(r.s)
    return sorted((d, n, [s[k] for k in range(d)]) for d, (n, s) in found.items())


def _centred(x, n: int, s: list[int]):
    """n * x - S as int64 where that fits, else as Python integers."""
    import numpy as np

    if n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, s), default=0) < 1 << 62:
        return n * x - np.array(s, "i8")
    return n * _exact(x) - np.array(s, object)


def _triangle(rows):
    """The R factor of rows, as the rows of its upper triangle that aren't all zero."""
    import numpy as np

    return np.linalg.qr(rows, mode="r")


def factors(rows: DataFrame, fits: list[tuple[int, int, list[int]]]) -> dict[int, object]:
    """width -> R of all rows of that length less their mean."""
    import numpy as np

    by_width = {d: (n, s) for d, n, s in fits}

    def pack(width: int, r, part: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([part], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["width", "part", "r"])

    def compressed(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            for _, x in _blocks(b, 0):
                d = x.shape[1]
                if d:
                    n, s = by_width[d]
                    block = _centred(x, n, s).astype("f8") / n
                    held[d] = _triangle(np.concatenate([held[d], block]) if d in held else block)
            if sum(r.size for r in held.values()) > HELD_NUMBERS and len(held) > 1:
                yield from (pack(d, r, part) for d, r in held.items())
                held = {}
        yield from (pack(d, r, part) for d, r in held.items())

    def met(key, table):
        import pandas as pd

        d, r = int(key[0]), None
        for x in table["r"]:
            more = np.frombuffer(x, "<f8").reshape(-1, d)
            r = more if r is None else _triangle(np.concatenate([r, more]))
        return pd.DataFrame({"width": [d], "part": [int(key[1])], "r": [r.astype("<f8").tobytes()]})

    schema = "width int, part int, r binary"
    found = materialize(rows.select("vector").mapInArrow(compressed, schema), "factors")
    most = found.agg(F.max("part")).first()[0] or 0
    crowded = not found.groupBy("width").count().where("count > 1").isEmpty()
    while crowded:
        most //= FAN
        found = materialize(found.groupBy("width", F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(met, schema), "factors")
        crowded = most > 0
    return {r.width: np.frombuffer(r.r, "<f8").reshape(-1, r.width) for r in found.collect()}


def jacobi(r):
    """rotations V and column lengths, descending, with r @ V orthogonal: cyclic plane rotations of pairs of columns."""
    import numpy as np

    a = np.array(r, "f8").T.copy()  # a row for each column of r
    d = len(a)
    v = np.eye(d)
    size = np.abs(a).max() if a.size else 0.0
    if size:
        a /= size
    for _ in range(SWEEPS):
        worst = 0.0
        for p in range(d - 1):
            for q in range(p + 1, d):
                alpha, beta, gamma = a[p] @ a[p], a[q] @ a[q], a[p] @ a[q]
                if not gamma or abs(gamma) <= ORTHOGONAL * np.sqrt(alpha * beta):
                    continue
                worst = max(worst, abs(gamma) / np.sqrt(alpha * beta)) if alpha * beta else worst
                zeta = (beta - alpha) / (2.0 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1.0 / np.hypot(1.0, t)
                s = c * t
                a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if not worst:
            break
    lengths = np.sqrt((a * a).sum(axis=1)) * size
    order = np.argsort(-lengths, kind="stable")
    v, lengths = v[order], lengths[order]
    #: Rotations of near 10,000 pairs leave lengths off 1 by some last digits.
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    v *= np.where(v[np.arange(d), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return v.T, lengths


def fit(rows: DataFrame) -> list[dict]:
    """For each length of vectors: width, n, sums, components (columns), deviations (of the components) and explained."""
    fits = sums(rows)
    found = factors(rows, fits) if fits else {}
    out = []
    for d, n, s in fits:
        if d:
            v, lengths = jacobi(found[d])
            total = float((lengths**2).sum())
            explained = lengths**2 / total if total else lengths * 0.0
            k = min(COMPONENTS, d)
            deviations = lengths / n**0.5
            deviations[lengths <= FLAT * lengths[0]] = 0.0
            out.append({"width": d, "n": n, "sums": s, "components": v[:, :k], "deviations": deviations[:k], "explained": explained[:k]})
    return out


def _whitened(x, m: dict):
    """Projections on the components over their deviations, and n * x - S."""
    import numpy as np

    c = _centred(x, m["n"], m["sums"])
    e = m["deviations"]
    return (c.astype("f8") / m["n"]) @ m["components"] * np.where(e > 0, 1.0 / np.where(e > 0, e, 1.0), 0.0), c


def _pieces(models: list[dict]) -> list[dict[int, dict]]:
    """The models in groups of FIT_NUMBERS at most, by width; usually one."""
    out, size = [{}], 0
    for m in models:
        mine = m["components"].size + len(m["sums"])
        if out[-1] and size + mine > FIT_NUMBERS:
            out.append({})
            size = 0
        out[-1][m["width"]] = m
        size += mine
    return out


def _identity_errors(rows: DataFrame, models: list[dict]) -> dict[int, float]:
    """The largest entry of the whitened rows' covariance less the identity, for each width: moments of each task, then merged."""
    import numpy as np

    def merged(a, b):
        """n, mean, centred products of two sets of rows together."""
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    out: dict[int, float] = {}
    for piece in _pieces(models):

        def moments(batches, piece=piece):
            import pyarrow as pa

            held = {}
            for b in batches:
                for _, x in _blocks(b, 0):
                    if x.shape[1] in piece:
                        w, _ = _whitened(x, piece[x.shape[1]])
                        mean = w.mean(axis=0)
                        mine = (len(w), mean, (w - mean).T @ (w - mean))
                        held[x.shape[1]] = merged(held[x.shape[1]], mine) if x.shape[1] in held else mine
            for d, (n, mean, m2) in held.items():
                values = np.concatenate([mean, m2.ravel()]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([values], pa.list_(pa.float64()))], names=["width", "n", "m"])

        def met(key, table):
            import pandas as pd

            total = None
            for n, m in zip(table["n"], table["m"], strict=True):
                k = len(piece[int(key[0])]["deviations"])
                mine = (int(n), np.array(m[:k]), np.array(m[k:]).reshape(k, k))
                total = mine if total is None else merged(total, mine)
            return pd.DataFrame({"width": [int(key[0])], "n": [total[0]], "m": [[*total[1], *total[2].ravel()]]})

        schema = "width int, n long, m array<double>"
        parts = rows.select("vector").mapInArrow(moments, schema)
        some = parts.groupBy("width", F.pmod(F.hash("m"), F.lit(FAN)).alias("part")).applyInPandas(met, schema)
        for r in some.groupBy("width").applyInPandas(met, schema).collect():
            k = len(piece[r.width]["deviations"])
            real = piece[r.width]["deviations"] > 0
            cov = np.array(r.m[k:]).reshape(k, k) / r.n
            off = np.abs(cov - np.eye(k))[np.ix_(real, real)]
            out[r.width] = float(off.max()) if off.size else 0.0
    return out


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    import numpy as np

    rows = usable(vectors, id_col=id_col, vector_col=vector_col)
    models = fit(rows)
    errors = _identity_errors(rows, models)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def made(piece):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                for part, x in _blocks(b, 1):
                    m = piece.get(x.shape[1])
                    if m is None:
                        continue
                    w, c = _whitened(x, m)
                    k = w.shape[1]
                    if c.dtype == object or not c.size or c.shape[1] * float(np.abs(c).max()) ** 2 >= 1 << 62:
                        squares = [s if s < 1 << 63 else None for s in (_exact(c) ** 2).sum(axis=1).tolist()]
                    else:
                        squares = (c * c).sum(axis=1).tolist()
                    of_row = pa.array(np.repeat(part, k))
                    columns = [b.column(0).take(of_row), np.tile(np.arange(1, k + 1, dtype="i4"), len(part)), np.full(len(part) * k, m["n"], "i8")]
                    columns += [pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), k))), w.ravel(), np.tile(m["explained"], len(part)), np.full(len(part) * k, errors[x.shape[1]])]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema_names)

        return run

    schema_names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = None
    for piece in _pieces(models):
        part = rows.mapInArrow(made(piece), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
