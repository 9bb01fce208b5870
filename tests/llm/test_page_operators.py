"""Operators on pages and vectors against brute force, and their defined results on odd rows."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_text, url_filter, warc

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.example.com/fr/x", "block")]


def test_url_filter_matches_brute_force(spark):
    hosts = ["example.org", "www.EXAMPLE.org", "xexample.org", "org", "a.example.com", "b.com", "com", "", "a..org", "x.com:80", "é.org"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=1", "/fr/x/y#z", "/fr/", "/de/é", "?q", "#f", "/EN/1"]
    urls = [f"{s}{h}{t}" for s in ("http://", "https://a://") for h in hosts for t in tails] + [None, "", "no scheme", "://", "mailto:x", "http://a\nb.org/es/"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(None, urls[0], "x"), (0, urls[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_frame(spark, RULES)).collect()}
    want = set()
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
            path = rest[k:]
            path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fit = [(r, v) for r, v in RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        want.add((i, host, path, rule, verdict))
    assert got == want
    assert url_filter.judge(df, url_filter.rules_frame(spark, RULES).limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, RULES)).count() == 0


def pages():
    draw = random.Random(1)
    rows = [(i, f"http://h/{i}", "<p>" + "x" * draw.randint(0, 3000) + "</p>") for i in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nb", ""), (5, "again", rows[5][2]), (102, "http://é", rows[3][2]), (None, "u", rows[3][2]), (103, "big", "é" * 400_000), (None, "v", "only here")]
    return rows


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    first = {}
    for i, _, h in pages():
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages():
        raw, at = (h or "").encode(), first.get(h or "")
        response = at is None or i == at
        want.append((str(i), "response" if response else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if response else str(at)))
    want = [("None" if w[0] == "None" else w[0], *w[1:]) for w in want]
    assert [g if g[0] is not None else ("None", *g[1:]) for g in got] == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ranges_of_any_size_see_each_record_once(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(2)
    warc.write(df, path)
    counts = [sorted((str(r.record_id), r.payload_digest, bytes(r.payload or b"")) for r in warc.read(spark, path, range_bytes=n).collect()) for n in (1 << 30, 700, 4096)]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == len(pages())
    assert any(p == ("é" * 400_000).encode() for *_, p in counts[0])


def test_warc_refuses_false_magic():
    def member(data, level=6):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    inner = warc.MAGIC + b"\x00" * 7 + b"junk"
    records = [b"WARC/1.1\r\nWARC-Type: x\r\n\r\n" + inner * 5 + bytes([k]) for k in range(20)]
    data = b"".join(member(r, 0) + (warc.EMPTY_MEMBER if k % 2 else b"") for k, r in enumerate(records))
    for n in (1, 13, 100, len(data)):
        found = [x for a in range(0, len(data), n) for x in warc.members(io.BytesIO(data), a, min(a + n, len(data)))]
        assert found == records


def test_warc_damage_raises_and_each_range_is_a_task(spark, tmp_path):
    records = [b"WARC/1.1\r\nWARC-Type: x\r\n\r\n" + bytes([65 + k]) * 50 + random.Random(k).randbytes(400) for k in range(3)]
    packed = []
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed.append(z.compress(r) + z.flush() + warc.EMPTY_MEMBER)
    data = b"".join(packed)
    second = len(packed[0])
    read = lambda x, n: [r for a in range(0, len(x), n) for r in warc.members(io.BytesIO(x), a, min(a + n, len(x)))]
    assert read(data, 60) == read(data, len(data)) == records
    for place in (second, second + 20, second + 300):
        broken = bytearray(data)
        broken[place] ^= 0xFF
        for n in (40, 300, second, len(data)):
            with pytest.raises(ValueError):
                read(bytes(broken), n)
    for n in (40, 300, len(data)):
        with pytest.raises(ValueError):
            read(data[: second + len(packed[1]) + 100], n)
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), path)
    size = sum(f.stat().st_size for f in (tmp_path / "w").iterdir() if f.name.startswith("part"))
    assert warc.read(spark, path, range_bytes=3000).rdd.getNumPartitions() == -(-size // 3000)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body><header><p>Site header, long.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use cookies, sorry.</div><div id="main" class="content"><article><h1>Title &amp; more</h1><p><b>One,
 two&nbsp;three.<br>four<p>Five &lt;six&gt; &eacute;<ul><li>item one<li>item two</ul><script>var a = "<p>x</p>";</script><div class="ad">Buy this, now.</div>
<form><p>Name:</p><input></form></article></div><section id="comments"><p>Reader says, hello there, friend.</p></section><aside><p>Side, note.</p></aside><footer>&copy; me</footer>"""


def test_html_text_drops_compound_names():
    prose = "A long line of prose, with commas; and a stop. " * 4
    lost = ["post-comments", "article-comments", "comment-content", "article-sidebar", "entry-footer", "content-ad", "cookie-content", "post comments", "post-newsletter", "story-related", "post-navigation"]
    kept = ["post", "entry-header", "story-notice", "content has-sidebar", "article", "post social", "content_no"]
    parts = [f'<div class="{c}"><p>{prose}{k}</p></div>' for k, c in enumerate(lost + kept)]
    got = html_text.main_text(f"<body class='with-sidebar comments'>{''.join(parts)}<main class='sidebar'><p>{prose}main</p></main></body>")
    assert got.split("\n") == [f"{prose}{k}" for k in range(len(lost), len(lost + kept))] + [f"{prose}main"]


def test_html_text(spark):
    want = "Title & more\nOne, two three. four\nFive <six> é\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain, text"), (1, "u", PAGE), (4, "x", "<p>a<b>c"), (5, "y", "<script>x"), (6, "z", "<p>" + "long text. " * 50_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()
    assert sorted((str(r.page_id), r.text[:80], r.n_chars) for r in got) == sorted((str(i), t[:80], len(t)) for i, t in [(1, want), (2, ""), (3, ""), (None, "plain, text"), (1, want), (4, "ac"), (5, ""), (6, ("long text. " * 50_000).strip())])


def test_html_paths_without_an_article_element():
    body = "".join(f"<div class=c><p>Paragraph {k}, with some words; and marks.</p></div>" for k in range(5))
    page = f"<body><ul><li>a</li><li>b</li></ul>{body}<ul><li>x</li></ul></body>"
    assert html_text.main_text(page).split("\n") == [f"Paragraph {k}, with some words; and marks." for k in range(5)]


def plain_text(page, threshold):
    """The method in its plainest form on pages of known tags: html.parser, elements as objects, no marks but class ad."""
    from html.parser import HTMLParser

    blocks_ = {"html", "body", "article", "div", "p", "h1", "ul", "li", "nav", "footer", "header", "aside"}

    class Read(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.block, self.found = [], 0, []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "meta"):
                return self.handle_data(" ") if tag == "br" else None
            if tag in blocks_:
                self.block += 1
                at = [k for k, (t, _) in enumerate(self.open) if t == "p"]
                if at:
                    del self.open[at[-1] :]
            if tag == "li" and self.open and self.open[-1][0] == "li":
                self.open.pop()
            self.open.append((tag, dict(attrs).get("class") or ""))

        def handle_endtag(self, tag):
            self.block += tag in blocks_
            at = [k for k, (t, _) in enumerate(self.open) if t == tag]
            if at:
                del self.open[at[-1] :]

        def handle_data(self, data):
            names = [t for t, _ in self.open]
            if data and not {"head", "nav", "footer", "script", "style", "title"} & set(names):
                last = max((k for k, t in enumerate(names) if t in blocks_), default=0)
                self.found.append((self.block, tuple(self.open), tuple(self.open[:last]), data))

    r = Read()
    r.feed(page or "")
    r.close()
    text = {}
    for b, *_, t in r.found:
        text[b] = text.get(b, "") + t
    text = {b: " ".join(t.split()) for b, t in text.items() if t.split()}
    if not text:
        return ""
    where = {b: max((x for x in r.found if x[0] == b), key=lambda x: len(x[3].strip()))[1:3] for b in text}
    marks = lambda s: sum(c in ".,;:!?…、。，！？" for c in s)

    def ratio(k, key):
        own = [text[b] for b in text if where[b][k] == key]
        return sum(map(len, own)) / len(own) * (1 + sum(map(marks, own)) / len(own))

    order, smooth = list(text), {}
    for i, b in enumerate(order):
        near = [ratio(0, where[x][0]) for x in order[max(0, i - 1) : i + 2] if where[x][1] == where[b][1]]
        smooth.setdefault(where[b][0], []).append(sum(near) / len(near))
    value = {b: (sum(smooth[where[b][0]]) / len(smooth[where[b][0]]) * ratio(1, where[b][1])) ** 0.5 * (1e-6 if ("div", "ad") in where[b][0] else 1) for b in order}
    chosen = {b for b in order if value[b] >= threshold * max(value.values())}
    held = {where[b][1] for b in chosen}
    goes = lambda c: any(c[:k] in held and k and c[k - 1][0] not in ("html", "body") for k in range(len(c) + 1))
    return "\n".join(text[b] for b in order if b in chosen or (goes(where[b][1]) and not (("div", "ad") in where[b][0] and threshold)))


def test_html_text_matches_a_plain_version_on_every_page(spark, monkeypatch):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    kept = {}
    for threshold in (0.0, 0.1, 0.6):
        monkeypatch.setattr(html_text, "THRESHOLD", threshold)
        kept[threshold] = [html_text.main_text(h) for h in rows]
        assert kept[threshold] == [plain_text(h, threshold) for h in rows]
    assert sum(a != b for a, b in zip(kept[0.0], kept[0.1], strict=True)) > 200
    monkeypatch.setattr(html_text, "THRESHOLD", 0.1)
    #: Without any list of names, ratios alone leave out most of the adverts.
    monkeypatch.setattr(html_text, "DROPPED_WORDS", set())
    monkeypatch.setattr(html_text, "STRICT_WORDS", set())
    assert sum(html_text.main_text(h) == t for h, t in zip(rows, kept[0.1], strict=True)) > len(rows) / 2


def test_html_text_keeps_what_surrounds_or_is_named_oddly():
    import time

    assert html_text.main_text("<p title=don't>Hello there, friend.</p>") == "Hello there, friend."
    assert html_text.main_text('<div class="page-header-wrapper"><article><p>Hi there, you.</p></article></div>') == "Hi there, you."
    assert html_text.main_text('<div class="recipe-reply social-science"><p>Yes, it is. Good.</p></div>') == "Yes, it is. Good."
    prose = "<p>Long prose, with marks; and more of it here.</p>" * 3
    assert html_text.main_text(f"<article>{prose}<table><tr><td>1</td><td>x</td></tr></table><div class=ad>no no, no.</div></article>").endswith("\n1\nx")
    assert html_text.main_text(f'<article><p>Short.</p></article><ol class="commentlist"><li class="comment"><article>{prose}</article></ol>') == "Short."
    links = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(9)) + "</ul>"
    assert "Link" not in html_text.main_text(f"<div id=wrap>{links}{prose}{prose}</div>")
    began = time.perf_counter()
    html_text.main_text("<div>x" * 4000)
    first, began = time.perf_counter() - began, time.perf_counter()
    html_text.main_text("<div>x" * 32000)
    assert time.perf_counter() - began < 30 * first + 1


def brute(vectors, k=20):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], "f4").astype("f8")
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        s = x @ x[ids.tolist().index(q)]
        order = sorted((-a, i) for a, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_ann_recall_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 400)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + 0.8 * draw.normal(size=16)).astype("f4").tolist()) for i in range(1000)]
    rows += [(1000 + i, rows[40][1]) for i in range(300)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [None] * 16), (None, rows[0][1]), (40, rows[40][1]), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.search(ann.build_index(df), df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows)
    assert set(got) == set(want)
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    assert [r.vec_id for r in got[40]] == want[40]
    table = dict(rows)
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - float(np.dot(np.array(table[q], "f4").astype("f8"), np.array(table[r.vec_id], "f4").astype("f8")))) < 1e-12 for r in found)
    few = df.where("vec_id < 5")
    assert ann.search(ann.build_index(few), few.where("vec_id % 20 = 0")).count() == 4
    assert ann.search(ann.build_index(df), df.limit(0)).count() == 0
    assert ann.search(ann.build_index(df.limit(0)), df.where("vec_id = 20")).count() == 0


def test_ann_recall_on_unequal_norms_at_the_shard_of_the_query(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(40, 24))[draw.integers(0, 40, 4000)] + 0.6 * draw.normal(size=(4000, 24))
    x *= np.exp(draw.normal(size=(4000, 1)))  # log-normal lengths
    x[:1500] = draw.normal(size=(1500, 24))  # and vectors without any structure
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(ann.build_index(df), df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    scores = x[::20] @ x.T
    hits = []
    for k, row in enumerate(scores):
        row[20 * k] = -np.inf
        best = np.argsort(-row, kind="stable")[:20]
        hits.append(len(set(best.tolist()) & set(got[20 * k])) / 20)
        assert all(s == pytest.approx(row[i], rel=1e-12) for i, s in got[20 * k].items())
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.6
