"""The pipeline against a brute-force version on the smallest tables."""

import hashlib
import re
import zlib

import pytest

import corpus_pipeline
from tessera.llm import quality, toxicity
from test_jaccard import least_of_each

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def without_toxic(docs, labels):
    known = {i: t for i, t, _ in docs}
    marked = sorted((i, y) for i, y in labels if i in known and zlib.crc32(str(i).encode()) % 5)
    share = len(marked) / len(marked)
    numbers, bias = toxicity.train([known[i] for i, _ in marked], [y for _, y in marked], [share] * len(marked))
    return [d for d, z in zip(docs, toxicity.logits([t for _, t, _ in docs], numbers, bias), strict=True) if z < 0]


def passing_quality(docs):
    norm = lambda x: " ".join(WORD.findall(re.sub("[1-9]", "0", lower(x))))
    hosts, seen, out = {}, {}, []
    for _, t, s in docs:
        hosts.setdefault(s, set()).add(t)
        for x in {norm(x) for x in t.split("\n")} - {""}:
            seen.setdefault((s, x), set()).add(t)
    hot = {k for k, v in seen.items() if len(v) > quality.LINE_DOCS and len(v) > quality.LINE_SHARE * len(hosts[k[0]])}
    for i, t, s in docs:
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        repeated = len({k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(5)})
        lines = [norm(x) for x in t.split("\n")]
        left = sum(len(x.split()) for x in lines if (s, x) not in hot)
        lost = any((s, x) in hot for x in lines) and (left < quality.MIN_WORDS or left < quality.KEEP_SHARE * len(words))
        if len(words) >= 10 and 100 * repeated <= 20 * len(words) and not lost:
            out.append((i, t, s))
    return out


def one_of_each(docs):
    """The least id of each group linked by five-word shingles of similarity 0.8 and more, by all pairs."""
    kept = set(least_of_each([(i, t) for i, t, _ in docs]))
    return [d for d in docs if d[0] in kept]


def targets(sizes):
    """Weights 5, 2, 1 by name share 150 % of all words; what is above twice a source's words is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, left, found = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not full:
            found |= {s: share * weight[s] for s in open_}
            break
        found |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return found


def test_run_matches_brute_force(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    docs = [(r.doc_id, r.text or "", r.source) for r in table]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    kept = {i: (t, s) for i, t, s in one_of_each(passing_quality(without_toxic(docs, labels)))}
    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    copies, words = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        text, source = kept[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids) and r.n_tokens == len(ids) and r.source == source
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        words[source] = words.get(source, 0) + len(WORD.findall(text))
    assert max(copies.values()) <= 2
    sizes = {}
    for t, source in kept.values():
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(t))
    for source, goal in targets(sizes).items():
        assert words[source] == pytest.approx(goal, rel=0.02, abs=30)


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, raw long, k long, c0 long, copies int, _key string, payload int, rows int"


def odd_documents(spark):
    clash = ("x", 1, 2, 3, 4, "y", 5, 6)
    prose = [" ".join(f"{chr(97 + k)}w{j}" for j in range(40)) for k in range(6)]
    rows = [(k, t, "en", "s" if k % 2 else None, len(t), *clash) for k, t in enumerate(prose)]
    rows += [rows[0], rows[0], (0, prose[5] + " more", "en", "s", 1, *clash), (None, prose[1], None, None, None, *[None] * 8), (None, prose[1], None, None, None, *[None] * 8)]
    rows += [(20, None, None, None, None, *clash), (21, "", "en", "s", 0, *clash), (22, " \n\t", "en", "s", 3, *clash), (23, "one", "en", "s", 3, *clash)]
    rows += [(24, " ".join(f"word{j}" for j in range(150_000)), "en", "long", 1, *clash), (25, prose[2].upper(), "en", "s", 1, *clash), (2, prose[3], "en", "other", 1, *clash)]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_dedup", "source_mixing", "bpe_encoding"]
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), str(r.lang))
    every = sorted(map(key, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        found = sorted(map(key, got.collect()))
        assert got.columns == docs.columns and set(found) <= set(every), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    #: No invented text is toxic; each row keeps its own.
    assert sorted(map(key, corpus_pipeline.toxicity_stage(spark, docs, SF).collect())) == every
    #: Fewer than ten words, and nothing else, is refused.
    assert sorted(map(key, corpus_pipeline.quality_stage(spark, docs, SF).collect())) == [x for x in every if len(WORD.findall("" if x[1] == "None" else x[1])) >= 10]
    #: One row of each group: of equal texts the least id, of one id each text.
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect() if r.doc_id not in (20, 24))
    prose = [" ".join(f"{chr(97 + k)}w{j}" for j in range(40)) for k in range(6)]
    assert kept == [(0, prose[0]), (0, prose[5] + " more"), (1, prose[1]), (2, prose[2]), (2, prose[3]), (4, prose[4]), (23, "one")]
    #: No row takes over two copies of itself, and rows are told apart by id, text and source.
    mixed, given = {}, {}
    for x in map(key, corpus_pipeline.mixing_stage(spark, docs, SF).collect()):
        mixed[x] = mixed.get(x, 0) + 1
    for x in every:
        given[x] = given.get(x, 0) + 1
    assert all(n <= 2 * given[x] for x, n in mixed.items())
    encoded = corpus_pipeline.encoding_stage(spark, docs, SF)
    assert encoded.count() == len(every) and corpus_pipeline.encoding_stage(spark, docs.limit(0), SF).count() == 0
    assert encoded.where("n_tokens = 0").count() == 2


def test_mix_and_copies_agree_on_repeated_rows(spark):
    from tessera.llm import mixing

    rows = [(None, "same words here", "a", k % 3) for k in range(60)] + [(k, f"text {k} of this " * (k % 7 + 1), "ab"[k % 2], k) for k in range(40)] + [(3, "text", "a", 0), (3, "text", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rows int").repartition(4)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.copies
    got, each = {}, {}
    for r in mixing.apply(docs).collect():
        x = r.doc_id, len(r.text.split())
        got[x] = got.get(x, 0) + 1
        each[r] = each.get(r, 0) + 1
    assert got == {x: n for x, n in taken.items() if n}
    assert max(each.values()) <= 40 and {r["rows"] for r in each if r.doc_id is None} <= {0, 1, 2}


