"""Operators on texts against brute force, and their defined results on odd rows."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from test_jaccard import least_of_each

from tessera.llm import bpe, mixing, quality, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(300)]
    out = []
    for i in range(300):
        text = "\n".join(" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 8)))
        if i % 3 == 0:
            text = "The same line on every page\n" + text
        out.append((i, text, "en", draw.choice(["a", "b", "c", None]), len(text)))
    for i in range(40):
        copied = out[i][1].split(" ")
        copied[len(copied) // 2] = "changed"
        out.append((300 + i, " ".join(copied) if i % 2 else out[i][1], "en", "a", 0))
    odd = ["", None, " \n\t ", "one", "two words", "x " * 3000, "a b c d e " * 40, "Line\n" * 30, "\U0001f600 é ß\u00a0x", "<|endoftext|> end"]
    out += [(400 + k, t, None, None, None) for k, t in enumerate(odd)]
    out += [(None, "no id here at all", "en", "a", 1), (None, None, None, None, None), (7, out[7][1], "en", out[7][3], 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_matches_brute_force(docs, rows):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.score(docs).collect()}
    norm = lambda x: " ".join(WORD.findall(re.sub("[1-9]", "0", lower(x))))
    hosts, seen = {}, {}
    for _, t, _, s, _ in rows:
        hosts.setdefault(s, set()).add(t or "")
        for x in {norm(x) for x in (t or "").split("\n")} - {""}:
            seen.setdefault((s, x), set()).add(t or "")
    hot = {k for k, v in seen.items() if len(v) > quality.LINE_DOCS and len(v) > quality.LINE_SHARE * len(hosts[k[0]])}
    assert hot
    want = set()
    for i, t, _, s, _ in rows:
        n, chars, symbols, dup, rep = base(t)
        failed = n < 10 or 100 * rep > 20 * n
        lines = [norm(x) for x in (t or "").split("\n")]
        left = sum(len(x.split()) for x in lines if x and (s, x) not in hot)
        lost = any((s, x) in hot for x in lines) and (left < quality.MIN_WORDS or left < quality.KEEP_SHARE * n)
        want.add((i, n, chars, symbols, dup, rep, failed, not failed and not lost))
    assert got == want
    kept = [r.doc_id for r in quality.score(docs).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in quality.keep(docs).collect())
    assert quality.keep(docs).columns == docs.columns


def test_simhash_matches_brute_force(docs, rows):
    import xxhash

    def fingerprint(t):
        w = WORD.findall(lower(t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = sorted(((i, f"{p:016x}", least.get(root(k))) for k, ((i, *_), p) in enumerate(zip(rows, prints, strict=True))), key=str)
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    #: As near copies, texts are linked by their shingles, and of a group one row stays, with an id if any has one.
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert simhash.keep_one(docs).columns == docs.columns and len(kept) == len(set(kept))
    named = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda x: (x[0], hashlib.md5((x[1] or "").encode()).hexdigest()))
    places = least_of_each([(k, t) for k, (_, t) in enumerate(named)])
    assert sorted(kept, key=str) == sorted([named[k] for k in places] + [(None, "no id here at all")], key=str)


def test_simhash_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 64)
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(700)} | {draw.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    n, both = simhash._bit_counts(fps)
    from tessera.llm import components

    for parts in (simhash.plan(n, both), [(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(16 * k, 16 * k + 16)), 0) for k in range(4)]):
        got = {(r.u, r.v) for r in components.stars(simhash.links(fps, parts)).collect()}
        group = {v: v for v in signed}

        def root(x, group=group):
            while group[x] != x:
                x = group[x]
            return x

        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                    x, y = root(a), root(b)
                    group[max(x, y)] = min(x, y)
        assert got == {(v, root(v)) for v in signed if root(v) != v}


def test_simhash_thresholds_cover_every_pair():
    import numpy as np

    for n in (1_000, 10_000_000, 10**11):
        both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
        parts = simhash.plan(n, both)
        assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
        assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_bpe_matches_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.round_trip(docs.select("doc_id", "text", "key"), tokenizer()).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, b"".join(x.to_bytes(4, "little") for x in ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    separate = bpe.decode(bpe.encode(docs.select("doc_id", "text"), tokenizer()), tokenizer())
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in separate.collect()), key=str) == got


def test_bpe_random_strings_match_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer()), bpe.Bpe(tokenizer())
    draw = random.Random(3)
    letters = [*"aaabbcdeéè .,'stlm09\n\t-=_#", "<|endoftext|>", "日", "\U0001f600", "\x85", "\x1c", "'ll", "İ", "٣", "\u00a0"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    sums = token_counts.suffix_sums(token_counts.histogram(docs, tokenizer())).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths)
    for r in token_counts.limits(sums, [0, 10, 100000]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    for r in token_counts.quantiles(sums, [0.25, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[-(-int(r.share * len(lengths)) // 1) - 1] or sum(x <= r.n_tokens for x in lengths) / len(lengths) >= r.share
    assert token_counts.suffix_sums(token_counts.histogram(docs.limit(0), tokenizer())).count() == 0


def test_mixing_reaches_targets(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), n) for (i, *_), n in zip(rows, sizes, strict=True))
    by = {}
    for (_, _, _, s, _), n in zip(rows, sizes, strict=True):
        by[s] = by.get(s, 0) + n
    names = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    capped, budget = set(), 1.5 * sum(sizes)
    while True:
        free = [s for s in names if s not in capped]
        level = (budget - sum(2 * by[s] for s in capped)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * by[s]}
        if not over:
            break
        capped |= over
    want = {s: 2.0 * by[s] if s in capped else weights[s] * level for s in names}
    source = {str(i): s for i, _, _, s, _ in rows if i is not None}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        if r.doc_id is not None:
            s = source[str(r.doc_id)]
            assert r.target == pytest.approx(want[s], rel=1e-9) and r.source_size == by[s]
        taken[round(r.target, 3)] = taken.get(round(r.target, 3), 0) + r.taken
    for t, n in taken.items():
        assert n == pytest.approx(t, rel=0.01, abs=5)
    applied = mixing.apply(docs.repartition(5))  # works the rates out again, from other partitions
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    again = {r.doc_id: r["count"] for r in applied.groupBy("doc_id").count().collect()}
    assert applied.columns == docs.columns and again == {i: n for i, n in copies.items() if n}


def test_toxicity_learns_from_subwords(spark):
    draw = random.Random(4)
    clean = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(200)]
    rude = ["grumbletoad", "snarkfiend", "blightworm"]
    rows, labels = [], []
    for i in range(1500):
        words = [draw.choice(clean) for _ in range(draw.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000, "abc def " * 10 + "grumbletoadz " * 2), (5001, ""), (5002, None), (None, "x"), (5003, "GRUMBLETOAD snarkfiends " + "ab cd ef " * 8)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (9, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert got[5000].predicted == got[5003].predicted == 1 and got[5001].score == got[5002].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out
    clean_rows = toxicity.keep_clean(docs, marks)
    assert clean_rows.columns == docs.columns and clean_rows.count() == sum(r.predicted == 0 for r in got.values())
    assert {r.score for r in toxicity.score(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (quality.score, quality.keep, simhash.near_duplicates, simhash.keep_one, mixing.apply):
        assert f(none).count() == 0


def test_words_of_every_space():
    assert hashlib.sha1(b"").hexdigest() and WORD.findall("a\x0bb\x0cc\xa0d") == ["a", "b", "c\xa0d"]


def test_toxicity_training_and_scores_match_a_plain_dense_version(monkeypatch):
    import math

    import numpy as np

    monkeypatch.setattr(toxicity, "BUCKETS", 257)
    monkeypatch.setattr(toxicity, "STEP", 7)
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["good", "Day", "stupid!", "idiot", "über", "a", "(nice)", "words"]) for _ in range(draw.randint(0, 9))) for _ in range(40)]
    toxic, weight = [int("idiot" in t) for t in texts], [draw.choice([0.5, 2.0]) for _ in texts]

    def grams(word):
        inner = word.strip(toxicity.ENDS) or word
        raw = ("<" + inner + ">").encode()
        out = [raw]
        for n in (3, 4, 5):
            if len(raw) > n:
                out += [raw[k : k + n] for k in range(len(raw) - n + 1)]
        return [zlib.crc32(g) % 257 for g in out]

    x = np.zeros((len(texts), 257))
    for d, t in enumerate(texts):
        words = t.lower().split()
        for w in words:
            for g in grams(w):
                x[d, g] += 1 / len(words) / len(grams(w))
    x[:, (x > 0).sum(axis=0) < toxicity.LEAST_DOCS] = 0
    rng = np.random.default_rng(7)
    vectors, softmax, bias = np.zeros((257, toxicity.WIDTH)), rng.uniform(-0.5, 0.5, (toxicity.WIDTH, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-6) for v in (vectors, softmax, bias)]
    share = np.array(weight) / np.mean(weight)
    for k in range(toxicity.PASSES):
        rate, order = toxicity.RATE * (1 - k / toxicity.PASSES), rng.permutation(len(texts))
        for start in range(0, len(order), 7):
            docs = order[start : start + 7]
            inputs = x[docs] * toxicity.SCALE
            mean = inputs @ vectors
            z = np.exp(mean @ softmax + bias)
            error = z / z.sum(axis=1, keepdims=True) - np.eye(2)[np.array(toxic)[docs]]
            error *= share[docs][:, None] / len(docs)
            seen = (inputs > 0).any(axis=0)
            slopes = inputs.T @ (error @ softmax.T), mean.T @ error, error.sum(axis=0)
            sums[0][seen] += slopes[0][seen] ** 2
            pace = rate / np.sqrt(sums[0].mean(axis=1, keepdims=True))
            moved = vectors - pace * slopes[0]
            moved *= np.maximum(0, 1 - pace * toxicity.SHRINK / np.maximum(np.sqrt((moved**2).sum(axis=1, keepdims=True)), 1e-12))
            vectors[seen] = moved[seen]
            for value, slope, s in ((softmax, slopes[1], sums[1]), (bias, slopes[2], sums[2])):
                s += slope**2
                value -= rate * slope / np.sqrt(s)
    numbers, off = toxicity.train(texts, toxic, weight)
    want = vectors @ (softmax[:, 1] - softmax[:, 0]) * toxicity.SCALE
    assert np.allclose(numbers, want, rtol=0.02, atol=0.02 * np.abs(want).max()) and off == pytest.approx(bias[1] - bias[0], abs=0.02)
    for t, z in zip(texts, toxicity.logits(texts, numbers, off), strict=True):
        words = t.lower().split()
        plain = off + (sum(sum(float(numbers[g]) for g in grams(w)) / len(grams(w)) for w in words) / len(words) if words else 0.0)
        assert math.isclose(z, plain, rel_tol=1e-6, abs_tol=1e-6)


def test_mixing_keeps_large_ids_beside_null_ones(spark):
    draw = random.Random(11)
    rows = [((1 << 60) + k if k % 150 else None, " ".join(["w"] * draw.randint(1, 80)) + f" {k}", draw.choice(["a", "b", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(docs).collect()
    assert sorted(map(str, (r.doc_id for r in mixed))) == sorted(str(i) for i, *_ in rows)
    applied = mixing.apply(docs).collect()
    assert sum(len(r.text.split()) for r in applied) == sum(r.taken for r in mixed)
    assert {r.doc_id for r in applied} <= {i for i, *_ in rows}


def test_mixing_raises_where_the_dual_stays_unsolved(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 4)
    with pytest.raises(ArithmeticError, match="isn't solved"):
        mixing.mix(docs).collect()


def test_toxicity_learns_from_a_class_of_long_texts_only(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30)), 0) for i in range(200)]
    rows += [(1000 + i, " ".join(word() if k % 20 else "grumbletoad" for k in range(12_000)), 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1001, "another text of the id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {(r.doc_id, r.held_out): r.predicted for r in toxicity.score(docs, labels).where("doc_id != 1001").collect()}
    assert [got[i, zlib.crc32(str(i).encode()) % 5 == 0] for i, _, _ in rows if i != 1001] == [y for i, _, y in rows if i != 1001]


def test_bpe_remembers_in_two_generations(monkeypatch, rows):
    texts = [t or "" for _, t, *_ in rows]
    want = bpe.Bpe(tokenizer()).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 5_000)
    small = bpe.Bpe(tokenizer())
    assert [small.encode([t])[0] for t in texts] == want
    assert small.older and small.held < 5_000 + max(map(len, texts)) * 250


def test_toxicity_learns_in_a_task_not_in_the_driver(spark, monkeypatch):
    draw = random.Random(14)
    rows = [(i, " ".join(draw.choice(["ab", "cde", "fgh", "grumbletoad" if i % 3 == 0 else "ij"]) for _ in range(25)) if i else "", int(i % 3 == 0)) for i in range(300)]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    numbers, bias = toxicity.train([t for _, t, _ in known], [y for *_, y in known], [1.0] * len(known))
    want = toxicity.logits([t for _, t, _ in rows], numbers, bias)

    driver = os.getpid()

    def elsewhere(*given):
        from tessera.llm import toxicity

        if os.getpid() == driver:
            raise AssertionError("learned in the driver")
        return toxicity.learn(*given)

    monkeypatch.setattr(toxicity, "learn", elsewhere)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs.repartition(5), labels).collect()}
    assert [got[i] for i, *_ in rows] == pytest.approx([1 / (1 + 2.718281828459045**-z) for z in want], abs=1e-9)


def test_toxicity_buckets_remembered_for_another_number_of_buckets_are_not_used(monkeypatch):
    text = "grumbletoad and snarkfiend"
    wide = toxicity.bag(text)[0].tolist()
    monkeypatch.setattr(toxicity, "BUCKETS", 257)
    narrow = toxicity.bag(text)[0].tolist()
    assert max(narrow) < 257 and set(narrow) == {b % 257 for w in text.split() for b in toxicity.features(w)}
    monkeypatch.undo()
    assert toxicity.bag(text)[0].tolist() == wide
