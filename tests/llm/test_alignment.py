"""The alignment of two tokenizers against one that encodes whole texts with the libraries and compares all tokens."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment
from tessera.llm.bpe import _byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), _byte_of_char()


def plain(texts, libraries):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text."""
    a, b, table = libraries
    made, holds = [], {}
    for t in texts:
        if not t:
            made.append(None)
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        x, y = e.ids, b.encode(t)
        of_x = [bytes(table[c] for c in token) for token in e.tokens]
        of_y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not b"".join(of_x) == b"".join(of_y) == (" " + t).encode():
            made.append(None)
            continue
        sx, sy = spans(map(len, of_x)), spans(map(len, of_y))
        links, low = [], 0
        for i, (s, t_end) in enumerate(sx):
            for j in range(low, len(sy)):
                if sy[j][0] >= t_end:
                    break
                if sy[j][1] <= s:
                    low = j
                else:
                    links.append((x[i], y[j]))
        both = {e for _, e in sx} & {e for _, e in sy}
        cut = lambda ids, sp: "".join(str(i) + (";" if e in both else ",") for i, (_, e) in zip(ids, sp, strict=True))[:-1].split(";")
        groups = ";".join(f"{g}|{h}" for g, h in zip(cut(x, sx), cut(y, sy), strict=True))
        made.append((len(x), len(y), len(both), links, hashlib.sha256(groups.encode()).hexdigest()))
        for pair in set(links):
            holds[pair] = holds.get(pair, 0) + 1
    most = {}
    for (i, _), n in holds.items():
        most[i] = max(most.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(holds[p] == most[p[0]] for p in m[3]), sum(holds[p] for p in m[3]), m[4]) for m in made]


ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n b \n\n  c", "\t\tx\ty", "▁x y", "x▁ y", "<s> <0x0A> <|endoftext|>end <unk>", "a\0b c", "\U0001f600 é ß x 　 y",
    "can't won't I'll ' s 's", "1 2,3 4.5 %&* -- __init__ a_b", "x " * 3000, "y" * 5000, " " * 300 + "z", "日本語 テスト 한국어 ไทย", "é e ́ ​ z\u0085q", "same text here", "same text here",
]


def test_alignment_matches_libraries(spark, libraries, monkeypatch):
    draw = random.Random(3)
    signs = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "1", "23", ".", "'s", "-", "_", "▁", "日", " ", "the", "ing", " of", "\r\n", "́", "<|endoftext|>"]
    texts = ODD + ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(600)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(None if k % 50 == 7 else k + (1 << 60), t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").withColumn("id", F.lit(1)).repartition(5)
    out = alignment.align(docs, A, B)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.columns == ["doc_id", *names]
    got = sorted(((r.doc_id, *(r[c] for c in names)) for r in out.collect()), key=str)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain(texts, libraries), strict=True)), key=str)


def test_small_memories_change_nothing(libraries, monkeypatch):
    texts = ["one two three", "two three four", "▁ two", "", "four five\nsix  seven"]
    whole = alignment.Aligner(A, B).documents(texts)
    monkeypatch.setattr(alignment, "STRETCH_BYTES", 1)
    short = alignment.Aligner(A, B)
    assert [sum((short.documents([t])[k] for t in texts), []) for k in range(7)] == whole
    short.cuts = False
    short._forget()
    assert short.documents(texts) == whole


def test_partial_counts_and_runs_add_up(spark, monkeypatch):
    monkeypatch.setattr(alignment, "GATHERED", 3)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 2)
    import numpy as np

    docs = [[1, 2, 3], [2, 3], [3], [], [1 << 40, (1 << 40) + 5], [3, 1 << 40]]
    rows = spark.createDataFrame([(np.array(x, "<i8").tobytes(),) for x in docs], "pairs binary").repartition(2)
    got = {r.pair: r.n for r in alignment.pair_counts(rows).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 1 << 40: 2, (1 << 40) + 5: 1}


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string"), A, B).collect() == []
    only = alignment.align(spark.createDataFrame([(None, None), ("a", "")], "doc_id string, text string"), A, B)
    assert sorted(only.select("n_links", "groups_sha256").collect()) == [(0, ""), (0, "")]
