"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a document the mean of its words;
the vectors (hashed into BUCKETS rows) and the softmax are trained jointly in numpy with Adagrad, on a bounded
sample of labelled documents; each step shrinks the vectors, so those of n-grams that tell nothing stay zero. Misspellings that were never seen share n-grams, and so vectors, with words
that were. A score is linear in the document's mean before the softmax, so what goes to the tasks is one
number for each bucket; tasks score whole texts, with a bounded memory of words.

The sample: POSITIVES toxic and NEGATIVES other labelled documents at most, the first in the order of a hash of
their ids, weighted back to the classes' shares. Their n-grams are counted in the tasks, from whole texts: a number for each
bucket of a document, BUCKETS at most. One task learns from these numbers, which it keeps in an unnamed file and reads a
step at a time; the driver gets the BUCKETS numbers that are learned. Of the ids only the hash decides
what is learned from; of several texts of an id the one with the least hash is taken.

Defined results: a null or empty text gets the softmax of its bias alone. Null ids keep a row each, are held
out and never learned from. Without usable labels of both classes every score is the share of toxic labels
(0 if there are none). Repeated rows keep a row each. An empty table gives an empty result. Other columns
aren't read by score() and are passed on by keep_clean().
"""

from __future__ import annotations

import math
import tempfile
import zlib
from array import array
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents to learn from, of each class, at most.
POSITIVES, NEGATIVES = 1500, 2500
#: Rows and width of the vectors, n-gram lengths.
BUCKETS, WIDTH, LENGTHS = 1 << 17, 8, (3, 4, 5)
#: Scale of a mean before the softmax, passes, documents in a step, learning rate, what a step takes off a vector's length.
SCALE, PASSES, STEP, RATE, SHRINK = 256.0, 12, 128, 0.3, 2e-4
#: Documents of the sample that a bucket must occur in.
LEAST_DOCS = 3
#: Every FOLDS-th id, by crc32 of its digits, is held out.
FOLDS = 5
#: Words that a worker remembers before it starts anew.
REMEMBERED = 150_000
#: Characters that are taken off both ends of a word.
ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features(word: str) -> list[int]:
    """Buckets of the word and its n-grams, ends marked."""
    marked = f"<{word.strip(ENDS) or word}>".encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, len(marked)
    return [crc(marked) % BUCKETS, *[crc(marked[i : i + k]) % BUCKETS for k in LENGTHS for i in range(min(n - k + 1, n) if n > k else 0)]]


def held_out(doc_id: Column) -> Column:
    """True for the ids that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str):
    """_id, toxic, at, x (the buckets of a document and their parts, packed) of the documents to learn from, and the labelled ones of each class."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = known.select("_id").join(marked, "_id")
    totals = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    chosen = [ids.where(F.col("toxic") == c).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most) for c, most in ((1, POSITIVES), (0, NEGATIVES))]
    texts = known.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id").groupBy("_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                one, x = bag(b.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([_packed(one)]), pa.array([zlib.compress(x.tobytes(), 1)])], names=["_id", "toxic", "at", "x"])

    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(counted, f"_id {kind}, toxic int, at binary, x binary"), totals


def learned(picked: DataFrame, totals: dict[int, int]):
    """learn() from what sample() gives, by one task; None without documents of both classes."""

    def fit(batches):
        import numpy as np
        import pyarrow as pa

        toxic, sizes = [], []
        with tempfile.TemporaryFile() as file:
            for b in batches:
                for k in range(b.num_rows):
                    toxic.append(b.column(1)[k].as_py())
                    at, x = _unpacked(b.column(2)[k].as_py(), b.column(3)[k].as_py())
                    sizes.append(len(at))
                    file.write(at.tobytes() + x.tobytes())
            if len(set(toxic)) < 2:
                return
            file.flush()
            ends = np.cumsum([0, *sizes]).tolist()
            both = np.memmap(file, "i4", "r", shape=(2 * ends[-1],)).view(np.ndarray) if ends[-1] else np.empty(0, "i4")
            columns = [both[2 * e : 2 * e + n] for e, n in zip(ends, sizes)]
            values = [both[2 * e + n : 2 * e + 2 * n].view("f4") for e, n in zip(ends, sizes)]
            of = Counter(toxic)
            numbers, bias = learn(columns, values, toxic, [totals[c] / of[c] for c in toxic])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()]), pa.array([bias])], names=["numbers", "bias"])

    found = picked.repartition(1).sortWithinPartitions("_id").mapInArrow(fit, "numbers binary, bias double").collect()
    if not found:
        return None
    import numpy as np

    return np.frombuffer(found[0].numbers, "f4"), found[0].bias


_grams: dict[str, array] = {}
_grams_of: list = [None]


def bag(text: str):
    """The buckets of a text (int32, ascending) and the part of each (float32): means of words of means of n-grams."""
    import numpy as np

    counts = Counter(text.lower().split())
    total = sum(counts.values())
    at, x, sizes = array("i"), [], []
    if len(_grams) > REMEMBERED or _grams_of[0] != (BUCKETS, LENGTHS):
        _grams.clear()
        _grams_of[0] = BUCKETS, LENGTHS
    for w, c in counts.items():
        f = _grams.get(w)
        if f is None:
            f = _grams[w] = array("i", features(w))
        at += f
        sizes.append(len(f))
        x.append(c / total / len(f))
    one, where = np.unique(np.asarray(at, "i4"), return_inverse=True)
    parts = np.bincount(where, np.repeat(np.asarray(x, "f8"), sizes), minlength=len(one)) if len(one) else np.empty(0)
    return one, parts.astype("f4")


def _packed(buckets) -> bytes:
    """Ascending buckets as deflated differences."""
    import numpy as np

    return zlib.compress(np.diff(buckets, prepend=np.int32(0)).astype("i4").tobytes(), 1)


def _unpacked(at: bytes, x: bytes):
    """The buckets of a document and their parts."""
    import numpy as np

    return np.cumsum(np.frombuffer(zlib.decompress(at), "i4"), dtype="i4"), np.frombuffer(zlib.decompress(x), "f4")


def train(texts: list[str], toxic, weight):
    """learn() from texts."""
    bags = [bag(t) for t in texts]
    return learn([at for at, _ in bags], [x for _, x in bags], toxic, weight)


def learn(columns: list, values: list, toxic, weight):
    """The trained number of each bucket (float32) and the bias; a score is the logistic function of their sum.

    columns, values: the buckets of each document and their parts, as bag() gives them, in memory or mapped from a file.
    """
    import numpy as np

    toxic, weight = np.asarray(toxic, "i8"), np.asarray(weight, "f4")
    weight = weight / weight.mean()
    often = np.zeros(BUCKETS, "i8")
    for c in columns:
        often[c] += 1
    often = often >= LEAST_DOCS
    draw = np.random.default_rng(7)
    vectors = np.zeros((BUCKETS, WIDTH), "f4")
    softmax = draw.uniform(-0.5, 0.5, (WIDTH, 2)).astype("f4")
    bias = np.zeros(2, "f4")
    seen = [np.full_like(x, 1e-6) for x in (vectors, softmax, bias)]
    for turn in range(PASSES):
        rate = RATE * (1 - turn / PASSES)
        order = draw.permutation(len(columns))
        for start in range(0, len(order), STEP):
            docs = order[start : start + STEP]
            kept = [often[columns[d]] for d in docs]
            at = np.concatenate([columns[d][k] for d, k in zip(docs, kept)])
            x = np.concatenate([values[d][k] for d, k in zip(docs, kept)]) * np.float32(SCALE)
            sizes = np.array([np.count_nonzero(k) for k in kept])
            row = np.repeat(np.arange(len(docs)), sizes)
            found, where = np.unique(at, return_inverse=True)
            part = vectors[found]
            mean = np.stack([np.bincount(row, x * part[where, j], minlength=len(docs)) for j in range(WIDTH)], axis=1).astype("f4")
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), toxic[docs]] -= 1
            p *= (weight[docs] / len(docs))[:, None]
            back = p @ softmax.T
            slope = np.stack([np.bincount(where, x * back[row, j], minlength=len(found)) for j in range(WIDTH)], axis=1).astype("f4")
            seen[0][found] += slope**2
            pace = rate / np.sqrt(seen[0][found].mean(axis=1, keepdims=True))
            part = part - pace * slope
            length = np.sqrt((part**2).sum(axis=1, keepdims=True))
            vectors[found] = part * np.maximum(0, 1 - pace * SHRINK / np.maximum(length, 1e-12))
            for value, g, s in ((softmax, mean.T @ p, seen[1]), (bias, p.sum(axis=0), seen[2])):
                s += g**2
                value -= rate * g / np.sqrt(s)
    return (vectors @ (softmax[:, 1] - softmax[:, 0]) * np.float32(SCALE)).astype("f4"), float(bias[1] - bias[0])


_remembered: dict[str, float] = {}
_of: list = [0, []]


def logits(texts, numbers, bias: float) -> list[float]:
    """The scores of texts before the logistic function."""
    stamp = zlib.crc32(numbers.tobytes())
    if _of[0] != stamp:
        _remembered.clear()
        _of[:] = stamp, numbers.tolist()
    number = _of[1].__getitem__
    out = []
    for t in texts:
        counts = Counter((t or "").lower().split())
        if len(_remembered) > REMEMBERED:
            _remembered.clear()
        total = 0.0
        for w, c in counts.items():
            z = _remembered.get(w)
            if z is None:
                f = features(w)
                z = _remembered[w] = math.fsum(map(number, f)) / len(f)
            total += c * z
        out.append(bias + (total / sum(counts.values()) if counts else 0.0))
    return out


def _classified(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, Column, Column]:
    """docs with its columns renamed to c0, c1 ... and a score, and the columns of the id and the score."""
    picked, totals = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    found = learned(picked, totals)
    if found is None:
        value = F.lit(totals.get(1, 0) / max(1, sum(totals.values())))
    else:
        numbers, bias = found

        @F.arrow_udf("double")
        def scored(texts):
            import pyarrow as pa

            #: A few texts of the batch at a time are Python strings.
            parts = (logits(texts.slice(k, 200).to_pylist(), numbers, bias) for k in range(0, len(texts), 200))
            return pa.array([1 / (1 + math.exp(-min(max(z, -700), 700))) for p in parts for z in p], pa.float64())

        value = scored(f"c{docs.columns.index(text_col)}")
    return d.withColumn("score", value), F.col(f"c{docs.columns.index(id_col)}"), F.col("score")


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    d, name, value = _classified(docs.select(id_col, text_col), labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return d.select(name.alias(id_col), held_out(name).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    d, _, value = _classified(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return d.where(value < 0.5).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
