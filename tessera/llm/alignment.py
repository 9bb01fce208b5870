"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how many documents hold each pair.

Every text is encoded by A (a byte-level BPE file) with a blank before it and by B (a sentencepiece model that adds
that blank). Byte offsets where tokens of both end cut the text into groups. The pieces between two neighbouring
ends of either lie in one token of A and one of B, so they are the links: the pairs of overlapping tokens.

Both tokenizers cut before a single blank that follows something else than a blank and comes before a letter, digit or
ASCII sign (checked on B's pieces when they are loaded), so a text is encoded stretch by stretch, and a worker
remembers the stretches it has aligned, within STRETCH_BYTES. A text with a stretch that doesn't come back byte by
byte is encoded whole and decided on that.

Counts: pairs are packed in an int64 (A's id in the upper 32 bits). Each partition counts the documents of its pairs by
np.unique; the partial counts are sorted globally by ranges and equal keys summed as runs, which gives sorted
shards. Spark hands the shards to all executors as files; there they are mapped into memory, and the pairs of
each document are looked up by binary search. A shard's size doesn't follow the documents: there are at most as many
pairs as the product of both vocabularies, and no more than were seen.

Defined results: texts that are null, empty, or whose tokens' bytes differ from blank and text have no tokens,
only zeros and an empty digest. Special tokens' strings in a text are plain text. Repeated rows and null ids keep a row
each, and each is a document of the counts. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import _byte_of_char, _mapped
from tessera.llm.common import materialize, release, scratch_path

#: Bytes that a worker's stretches may take before it starts anew; a stretch takes about OVERHEAD besides its own.
STRETCH_BYTES, OVERHEAD = 160 << 20, 250
#: Distinct pairs that a task holds before it hands on their counts, keys it gathers before it counts them.
HELD_PAIRS, GATHERED = 2_000_000, 4_000_000
#: Where both tokenizers cut.
_CUT = re.compile(r"(?<=[^ ]) (?=[\w!-/:-@\[-`{-~])")

_TOKENS = [(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", T.StringType()), ("pairs", T.BinaryType()), ("times", T.BinaryType())]


class Aligner:
    """Both tokenizers, their tokens' bytes, and the stretches aligned so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        table = _byte_of_char()
        ids = {i: bytes(table[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        ids |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a_bytes = [ids.get(i, b"") for i in range(max(ids) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.text_of = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        #: A cuts before such blanks by its pattern, and no piece of B reaches over a blank into the next stretch.
        self.cuts = bool(plain) and not any(re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.held = 0
        #: For each stretch n_a, n_b, n_groups, its first pair and its number of pairs; then the pairs of all.
        self.sizes, self.pairs, self.n_pairs = np.zeros((1024, 5), "i8"), np.zeros(4096, "i8"), 0

    def _room(self, stretches: int, pairs: int) -> None:
        import numpy as np

        if len(self.sizes) < stretches:
            self.sizes = np.concatenate([self.sizes, np.zeros((stretches, 5), "i8")])
        if len(self.pairs) < pairs:
            self.pairs = np.concatenate([self.pairs, np.zeros(pairs, "i8")])

    def align(self, stretches: list[str]):
        """sizes (n_a, n_b, n_groups, first pair, pairs), the pairs, and the groups' text (None: bytes differ) of each stretch."""
        import numpy as np

        of_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        of_b = self.b.encode(stretches, num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == b" " + s.encode() for s, a, b in zip(stretches, of_a, of_b, strict=True)]
        a_ids = np.array([i for g, a in zip(good, of_a, strict=True) if g for i in a], "i8")
        b_ids = np.array([i for g, b in zip(good, of_b, strict=True) if g for i in b], "i8")
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        ends = np.union1d(a_ends, b_ends)
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        pairs = a_ids[at_a] << 32 | b_ids[at_b]
        #: Tokens of A and B up to the end of each group.
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_upto, b_upto = (np.searchsorted(a_ends, both) + 1).tolist(), (np.searchsorted(b_ends, both) + 1).tolist()
        sizes, groups = np.zeros((len(stretches), 5), "i8"), []
        a_text, b_text, text_of = [], [], self.text_of
        for g, a, b in zip(good, of_a, of_b, strict=True):
            if g:
                a_text += [text_of[i] for i in a]
                b_text += [text_of[i] for i in b]
        a_at = b_at = group = first = 0
        for k, (g, a, b) in enumerate(zip(good, of_a, of_b, strict=True)):
            if not g:
                groups.append(None)
                continue
            made, start, last_a, last_b = [], group, a_at + len(a), b_at + len(b)
            while a_at < last_a:
                to_a, to_b = a_upto[group], b_upto[group]
                made.append(",".join(a_text[a_at:to_a]) + "|" + ",".join(b_text[b_at:to_b]))
                a_at, b_at, group = to_a, to_b, group + 1
            n = len(a) + len(b) - (group - start)
            sizes[k] = len(a), len(b), group - start, first, n
            first += n
            groups.append(";".join(made).encode())
            assert b_at == last_b
        return sizes, pairs, groups

    def learn(self, stretches: set[str]) -> None:
        """Aligns the stretches that aren't known."""
        if self.held > STRETCH_BYTES:
            self._forget()
        new = [s for s in stretches if s not in self.known]
        if not new:
            return
        sizes, pairs, groups = self.align(new)
        at, first = len(self.groups), self.n_pairs
        self._room(at + len(new), first + len(pairs))
        sizes[:, 3] += first
        self.sizes[at : at + len(new)] = sizes
        self.pairs[first : first + len(pairs)] = pairs
        self.n_pairs += len(pairs)
        self.groups += groups
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        self.held += 8 * len(pairs) + sum(len(s) + len(g or b"") + OVERHEAD for s, g in zip(new, groups, strict=True))

    def documents(self, texts: list[str | None]):
        """n_a, n_b, n_groups, n_links, digest, distinct pairs and their times of each text, as lists."""
        import numpy as np

        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        self.learn(set().union(*cut))
        out = [[] for _ in _TOKENS]
        known, groups = self.known.__getitem__, self.groups.__getitem__
        for text, parts in zip(texts, cut, strict=True):
            at = np.fromiter(map(known, parts), "i8", len(parts))
            made = [groups(k) for k in at.tolist()]
            sizes, all_pairs = self.sizes[at], self.pairs
            if None in made:
                sizes, all_pairs, made = self.align([text])
                sizes = sizes if made[0] is not None else sizes[:0]
            if not len(sizes):
                row = (0, 0, 0, 0, "", b"", b"")
            else:
                n = sizes[:, 4]
                place = np.arange(n.sum()) + np.repeat(sizes[:, 3] - (np.cumsum(n) - n), n)
                pairs, times = np.unique(all_pairs[place], return_counts=True)
                digest = hashlib.sha256(b";".join(made)).hexdigest()
                row = (*sizes[:, :3].sum(axis=0).tolist(), int(n.sum()), digest, pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """A worker loads two tokenizers once."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def tokens(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs (int64) with their times (int32) as binary."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _mapped(d, "text", _TOKENS, lambda texts: aligner(a_path, b_path).documents(texts), ["id"])


def _partial(batches):
    """pair, n: how many of the documents in a partition hold each pair."""
    import numpy as np
    import pyarrow as pa

    keys, n, waiting, size = np.zeros(0, "i8"), np.zeros(0, "i8"), [], 0

    def counted(keys, n, waiting):
        found, times = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], n[:0])
        every, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([n, times]), len(every)).astype("i8")

    def rows(keys, n):
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

    for b in batches:
        for value in b.column(0):
            found = np.frombuffer(value.as_buffer(), "<i8")
            waiting.append(found)
            size += len(found)
            if size > GATHERED:
                keys, n = counted(keys, n, waiting)
                waiting, size = [], 0
                if len(keys) > HELD_PAIRS:
                    yield from rows(keys, n)
                    keys, n = keys[:0], n[:0]
    yield from rows(*counted(keys, n, waiting))


def _runs(batches):
    """Sums of equal neighbouring keys of a sorted partition."""
    import numpy as np
    import pyarrow as pa

    held, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sums, keys = np.add.reduceat(n, starts), keys[starts]
        if held is not None:
            if keys[0] == held:
                sums[0] += total
            else:
                keys, sums = np.concatenate([[held], keys]), np.concatenate([[total], sums])
        held, total = keys[-1], sums[-1]
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["pair", "n"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total], pa.int64())], names=["pair", "n"])


def pair_counts(token_rows: DataFrame) -> DataFrame:
    """pair, n: the documents that hold each pair, as a table whose files are sorted shards of disjoint ranges."""
    spark = token_rows.sparkSession
    partial = materialize(token_rows.select("pairs").mapInArrow(_partial, "pair long, n long"), "partial-pairs")
    path = scratch_path(spark, "pair-counts")
    partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(_runs, "pair long, n long").write.parquet(path)
    release(partial)
    return spark.read.schema("pair long, n long").parquet(path)


_mapped_shards: dict[tuple[str, ...], list] = {}


def _shards(names: tuple[str, ...]) -> list:
    """The shards that Spark has handed to this executor, mapped into memory, in the order of their keys."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    if names not in _mapped_shards:
        _mapped_shards.clear()
        found = []
        for name in names:
            at = SparkFiles.get(name)
            if not os.path.exists(at + ".npy"):
                t = pq.read_table(at)
                mine = f"{at}.{os.getpid()}.npy"
                np.save(mine, np.stack([t.column("pair").to_numpy(), t.column("n").to_numpy()]))
                os.replace(mine, at + ".npy")
            shard = np.load(at + ".npy", mmap_mode="r")
            if shard.shape[1]:
                found.append(shard)
        _mapped_shards[names] = sorted(found, key=lambda s: s[0, 0])
    return _mapped_shards[names]


def _counts_of(shards: list, pairs):
    """The count of each of some sorted pairs, all of which are in the shards."""
    import numpy as np

    out = np.zeros(len(pairs), "i8")
    cuts = np.searchsorted(pairs, [s[0, 0] for s in shards]).tolist() + [len(pairs)]
    for shard, start, end in zip(shards, cuts, cuts[1:], strict=False):
        if start < end:
            out[start:end] = shard[1][np.searchsorted(shard[0], pairs[start:end])]
    return out


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best counts the links whose pair is in as many documents as any pair of its A id, count_sum sums all links' counts.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = materialize(tokens(docs, a_path, b_path, id_col=id_col, text_col=text_col), "aligned")
    counts = pair_counts(rows)
    #: One number for each token of A at most.
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(int(top["a"].max()) + 1 if len(top) else 1, "i8")
    best[top["a"].to_numpy("i8")] = top["n"].to_numpy("i8")
    files = sorted(counts.inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    names = tuple(f.rpartition("/")[2] for f in files)

    def looked_up(batches):
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                pairs = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column(part.schema.get_field_index("pairs"))]
                times = [np.frombuffer(x.as_buffer(), "<i4") for x in part.column(part.schema.get_field_index("times"))]
                every, at = np.unique(np.concatenate(pairs), return_inverse=True)
                n = _counts_of(_shards(names), every)
                is_best = n == best[every >> 32] if len(every) else np.zeros(0, bool)
                sums, bests, k = [], [], 0
                for t in times:
                    own = at[k : k + len(t)]
                    sums.append(int(np.dot(n[own], t)))
                    bests.append(int(t[is_best[own]].sum()))
                    k += len(t)
                columns = {c: part.column(part.schema.get_field_index(c)) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
                columns |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
                columns["groups_sha256"] = part.column(part.schema.get_field_index("groups_sha256"))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(looked_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
