"""BPE encoding and decoding by traversal of a prefix-sharing trie.

The distinct words of a batch, in the order of their bytes, are a trie in depth-first order: the stack of a
traversal holds, for each prefix on the current path, the last token of that prefix's encoding, so a prefix
that words share is encoded once. The last token of a prefix is the one token that ends there, encodes to
itself, and may follow the last token of what precedes it; a word's encoding is read back along these
tokens. Two tokens may follow each other if no merge crosses the seam before the merges that made them.

Defined results: a null or empty text has no ids and decodes to the empty text. The strings of special
tokens in a text become their ids. Repeated rows and null ids keep a row each, an empty table gives an empty
result, other columns are passed on. A column named like an output is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from struct import pack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of words and their ids that a worker remembers in each of two generations, and what a word takes besides its own.
REMEMBERED_BYTES, OVERHEAD = 64 << 20, 200
#: Pairs of tokens and steps that a worker remembers before it starts anew.
PAIRS, STEPS = 400_000, 400_000
#: Characters of text that are encoded together.
BLOCK_CHARS = 1_000_000
#: The byte-level pre-tokenizer's pattern (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + k)] = b
    return table


class Bpe:
    """The tables of a byte-level BPE tokenizer file, and the encodings worked out so far."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse_other(spec)
        chars = _byte_of_char()
        raw = lambda piece: bytes(chars[c] for c in piece)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(piece): i for piece, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[left], vocab[right]
            self.rank[pair] = r
            self.made.setdefault(vocab[left + right], (r, *pair))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.prefixes = {b[:n] for b in self.id_of for n in range(len(b) + 1)}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: The words of late, with those of the block at hand, and the generation before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self._forget()

    @staticmethod
    def _refuse_other(spec: dict) -> None:
        """Raises for a tokenizer file with parts that would be left out here."""
        pre = spec.get("pre_tokenizer") or {}
        flags = [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        plain = not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if spec["model"].get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or flags:
            raise ValueError(f"not a plain byte-level BPE: normalizer {spec.get('normalizer')}, added tokens that strip {flags}, or options of the model")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex", True) is not True:
            raise ValueError(f"not the byte-level pre-tokenizer: {pre}")

    def _forget(self) -> None:
        """Empties what was worked out on the way: states, steps and pairs."""
        #: A state is the longest end of what was read that starts a token; for each, the tokens that it ends with.
        self.states: dict[bytes, int] = {b"": 0}
        self.state_bytes: list[bytes] = [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.steps: list[dict[int, int]] = [{}]
        self.follows: dict[int, dict[int, bool]] = {}
        self.n_pairs = self.n_steps = 0

    def may_follow(self, first: int, second: int) -> bool:
        """No merge joins the end of first with the start of second, going back in time along the seam."""
        a, b, a_gone, b_gone, found = first, second, 1 << 60, 1 << 60, True
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < a_gone and r <= b_gone:
                found = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                a_gone, a = made_a[0], made_a[2]
            else:
                b_gone, b = made_b[0], made_b[1]
        self.follows.setdefault(first, {})[second] = found
        self.n_pairs += 1
        return found

    def is_whole(self, token: int) -> bool:
        """The token's bytes encode to the token itself: merging them in order of rank gives it back."""
        ids = [self.id_of[bytes([b])] for b in self.bytes_of[token]]
        while len(ids) > 1:
            r, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:])))
            if r == 1 << 60:
                break
            ids[k : k + 2] = [self.id_of[self.bytes_of[ids[k]] + self.bytes_of[ids[k + 1]]]]
        return ids == [token]

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte, worked out when it is first reached."""
        read = self.state_bytes[state] + bytes([byte])
        while read not in self.prefixes:
            read = read[1:]
        to = self.states.get(read)
        if to is None:
            to = self.states[read] = len(self.states)
            tokens = [self.id_of.get(read[k:]) for k in range(len(read))]
            self.ends.append([(t, len(read) - k) for k, t in enumerate(tokens) if t is not None and self.is_whole(t)])
            self.state_bytes.append(read)
            self.steps.append({})
        self.steps[state][byte] = to
        self.n_steps += 1
        return to

    def traverse(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Words in the order of their bytes, each with its ids; last[d] is the last token of the prefix of d bytes."""
        last, size, states = [-1], [0], [0]
        before = b""
        ends, steps, follows, step = self.ends, self.steps, self.follows, self.step
        none: dict[int, bool] = {}
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for d in range(shared, len(word)):
                to = steps[state].get(word[d])
                state = step(state, word[d]) if to is None else to
                for token, n in ends[state]:
                    start = d + 1 - n
                    if start:
                        found = follows.get(last[start], none).get(token)
                        if not (self.may_follow(last[start], token) if found is None else found):
                            continue
                    last.append(token)
                    size.append(n)
                    states.append(state)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= size[d]
            yield word, ids[::-1]
            before = word

    def learn(self, words: set[str]) -> None:
        """Remembers the encodings of words, as little-endian unsigned 32-bit ids.

        Once a generation is full it becomes the older one; a word of that one that occurs again is young again.
        """
        if self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        if self.n_pairs > PAIRS or self.n_steps > STEPS:
            self._forget()
        new = {}
        for w in words:
            if w not in self.known:
                ids = self.older.get(w)
                if ids is None:
                    new[w.encode("utf-8", "surrogatepass")] = w
                else:
                    self.known[w] = ids
                    self.held += len(w) + len(ids) + OVERHEAD
        for word, ids in self.traverse(sorted(new)):
            self.known[new[word]] = pack(f"<{len(ids)}I", *ids)
            self.held += len(word) + 4 * len(ids) + OVERHEAD

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.split.split(t) if self.split else [t] for t in texts]
        found = [[p if p in self.special else self.words.findall(p) for p in parts] for parts in cut]
        self.learn(set().union(*(p for parts in found for p in parts if not isinstance(p, str))))
        ids = self.known.__getitem__
        return [b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(ids, p)) for p in parts) for parts in found]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def tables(path: str) -> Bpe:
    """A worker reads a tokenizer file once."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _mapped(df: DataFrame, source: str, outputs: list[tuple[str, T.DataType]], f, keep: list[str] | None = None) -> DataFrame:
    """df (its columns of keep, None: all) with the output columns that f makes of the values of source, a block at a time."""
    names = [c for c in (df.columns if keep is None else keep) if c not in {n for n, _ in outputs}]
    kept = T.StructType([df.schema[c] for c in names])
    schema = T.StructType([*kept.fields, *(T.StructField(n, t) for n, t in outputs)])
    at, labels, others = df.columns.index(source), [n for n, _ in outputs], [df.columns.index(c) for c in names]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
        kinds = [types[t.simpleString()] for _, t in outputs]
        for batch in batches:
            start = 0
            values = batch.column(at)
            sizes = (pc.utf8_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.binary_length)(values).fill_null(0).to_pylist()
            while start < batch.num_rows:
                end, n = start, 0
                while end < batch.num_rows and n < BLOCK_CHARS:
                    n += sizes[end] + 1
                    end += 1
                made = f(values.slice(start, end - start).to_pylist())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=[*names, *labels])
                start = end

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and ids_col, binary: the ids as little-endian unsigned 32-bit integers. tokenizer: a file on every worker."""
    return _mapped(docs, text_col, [(ids_col, T.BinaryType())], lambda texts: [tables(tokenizer).encode([t or "" for t in texts])])


def decode(encoded: DataFrame, tokenizer: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded and text_col, the text of its ids."""
    return _mapped(encoded, ids_col, [(text_col, T.StringType())], lambda ids: [[tables(tokenizer).decode(i or b"") for i in ids]])


def round_trip(docs: DataFrame, tokenizer: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns of keep, None: all) with ids and decoded, in one pass: the ids are decoded where they were made."""

    def both(texts):
        bpe = tables(tokenizer)
        ids = bpe.encode([t or "" for t in texts])
        return [ids, [bpe.decode(i) for i in ids]]

    return _mapped(docs, text_col, [("ids", T.BinaryType()), ("decoded", T.StringType())], both, keep)


def n_tokens(ids: Column) -> Column:
    """The number of ids in a binary column of them."""
    return (F.octet_length(ids) / 4).cast("long")


def lengths(docs: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens of every row; the ids stay where they were made."""
    return _mapped(docs, text_col, [("n_tokens", T.LongType())], lambda texts: [[len(i) // 4 for i in tables(tokenizer).encode([t or "" for t in texts])]], [])
