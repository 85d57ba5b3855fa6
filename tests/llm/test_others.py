"""Embeddings, languages, toxicity, WARC records, mixing and the pipeline."""

from __future__ import annotations

import html
import os
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import embedding_dedup, language_id, mixing, toxicity, warc
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark, empty):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + k, 501 + k) for k in range(40)] + [(900, 900), (None, 3), (1000, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {}
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    assert got == label


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = [(k, [float(x) for x in base[k % 6] + rng.normal(size=16) * 0.08], k % 3 % 2) for k in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [nan] + [1.0] * 15, 1), (203, [inf] + [1.0] * 15, 1), (204, [1.0] * 16, None), (205, [None] + [1.0] * 15, 1), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (209, rows[0][1], 0), (210, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "vec_id long, embedding array<float>, label int, n int, grp string")
    good = {}
    for i, v, lab in rows:
        x = None if not v or any(c is None for c in v) else np.array(np.array(v, np.float32), float)
        if i is not None and lab is not None and x is not None and np.isfinite(x).all() and x.any():
            good[i] = (x, lab)
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    links = {i: {j for j, (y, m) in good.items() if j != i and m == lab and len(x) == len(y) and cos(x, y) >= 0.98} for i, (x, lab) in good.items()}
    want = {}
    for i, _, _ in rows:
        seen, stack = {i}, [i]
        while stack:
            new = links.get(stack.pop(), set()) - seen
            seen |= new
            stack += new
        want[i] = (len(links.get(i, ())), None if i is None else min(seen), i is not None and i == min(seen))
    for block in (1024, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert got == want
    assert sum(n for n, _, _ in want.values()) > 100
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


WORDS = {"en": "the house and with that from this water stone river people", "fr": "le chaumière et avec leur jusque pierre rivière peuple où être", "de": "das Haus und mit dass über Wasser Stein Fluss Völker während"}


def _text(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language(spark):
    rng = random.Random(4)
    train = spark.createDataFrame([(k, _text(lang, rng), lang) for k, lang in enumerate(list(WORDS) * 30)] + [(900, None, "en"), (901, "x", None)], "i long, t string, l string")
    langs, model = language_id.fit(train, "t", "l", "i")
    assert langs == ["de", "en", "fr"]
    pages = [(k, f"<html lang='{lang}'><style>the and with</style><p>{_text(lang, rng)}</p></html>", f"https://www.site{k % 5}.{lang}/x") for k, lang in enumerate(list(WORDS) * 20)]
    pages += [(100, "<html lang=fr><p>42</p></html>", "http://www.site2.fr/"), (101, None, None), (102, "<p>12 !!</p>", ""), (None, "<p>das Haus und mit Wasser</p>", "nonsense"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, html string, url string, host string, posterior double")
    rows = language_id.identify(df, langs, model, "page_id", "html", url_col="url", markup=True).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages) and all(got[k]["lang"] == list(WORDS)[k % 3] for k in range(60))
    assert got[100]["lang"] == "fr" and got[100]["text_lang"] is None and got[None]["lang"] == "de"
    assert got[101]["rejected"] and got[102]["rejected"] and got[101]["lang"] is None and not got[5]["rejected"]
    assert language_id.identify(df.limit(0), langs, model, "page_id", "html", url_col="url", markup=True).count() == 0
    assert language_id.identify(df, [], model, "page_id", "html").count() == 0


def test_toxicity(spark, odd):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + (rng.sample(["scoundrel", "nitwit", "blockhead"], 2) if toxic else [])
        rows.append((k, " ".join(rng.sample(words, len(words)))))
        if k < 500:
            labels.append((k, 1, int(toxic)))
    docs = odd.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("score", F.lit("x"))
    frame = spark.createDataFrame([*labels, (None, 1, 1), (700, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, frame).collect()}
    fresh = [got[k] for k in range(600) if k >= 500 or got[k]["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in fresh) >= 0.97 * len(fresh)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and None in got and got[10_003]["score"] == got[10_004]["score"]
    assert toxicity.score(docs.limit(0), frame).count() == 0 and {r["predicted"] for r in toxicity.score(odd, frame.limit(0)).collect()} == {0}


def test_toxicity_finds_copies_by_unpicked_words(spark):
    """A near copy of a toxic example that shares only words too rare to be picked finds that example."""
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + (" scoundrel nitwit" if k % 5 == 0 else "")) for k in range(300)]
    lonely = next(k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5)
    rows += [(lonely, " ".join(f"rare{j}" for j in range(20))), (2000, " ".join(f"rare{j}" for j in range(18)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0 or k == lonely)) for k, _ in rows[:-1]], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs.unionByName(docs.where(f"doc_id = {lonely}")), labels).collect()}
    assert got[2000]["evidence"] == [lonely] and got[2000]["similarity"][0] > 0.9


def test_index_is_exact():
    """Block-max search against all cosines."""
    rng = np.random.default_rng(8)
    idf = rng.uniform(1, 5, 30)
    examples = [(k, k % 2, sorted(rng.choice(30, rng.integers(0, 6), replace=False).tolist()), None) for k in range(500)]
    examples = [(i, y, t, rng.integers(1, 4, len(t)).tolist()) for i, y, t, _ in examples]
    index = toxicity.Index.build(examples, idf)
    dense = np.zeros((500, 30))
    for i, _, t, n in examples:
        dense[i, t] = (1 + np.log(np.array(n, float))) * idf[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    for _ in range(40):
        t = np.sort(rng.choice(30, 4, replace=False))
        n = rng.integers(1, 4, 4).astype(float)
        q = np.zeros(30)
        q[t] = (1 + np.log(n)) * idf[t]
        cos = dense @ (q / np.linalg.norm(q))
        last = np.sort(cos)[-10]
        at, s = index.nearest(t, n, 10)
        assert set(index.ids[at]) == {int(k) for k in np.flatnonzero((cos >= last - 1e-12) & (cos > 0))} and np.allclose(s, cos[index.ids[at]])


def test_index_searches_groups_exactly():
    """Examples of three languages and short ones: each text's group comes first, most of the others' blocks are left out, and the result is that of all cosines."""
    rng = np.random.default_rng(10)
    idf = rng.uniform(1, 5, 1300)

    def text(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = rng.choice(400, rng.integers(60, 90), replace=False, p=np.r_[np.full(100, 0.006), np.full(300, 0.4 / 300)]) + 400 * (k % 3)
        t = np.sort(np.r_[own, rng.choice(100, rng.integers(1, 4), replace=False) + 1200])
        t = t if k % 11 else t[-2:]
        return t, rng.integers(1, 4, len(t))

    examples = [(k, k % 2, *map(np.ndarray.tolist, text(k))) for k in range(4500)]
    index = toxicity.Index.build(examples, idf)
    dense = np.zeros((4500, 1300))
    for i, _, t, n in examples:
        dense[i, t] = (1 + np.log(np.array(n, float))) * idf[t]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    queries = [(t, n.astype(float), 7 * i if i % 2 else None) for i, (t, n) in enumerate(text(k) for k in range(300))] + [(np.zeros(0, np.int64), np.zeros(0), None)]
    assert len(index.steer[0]) > 2
    for (t, n, without), (at, s) in zip(queries, index.search(queries, 10), strict=True):
        q = np.zeros(1300)
        q[t] = (1 + np.log(n)) * idf[t]
        cos = dense @ (q / (np.linalg.norm(q) or 1))
        if without is not None:
            cos[without] = 0
        last = np.sort(cos)[-10]
        assert set(index.ids[at]) == {int(k) for k in np.flatnonzero((cos >= last - 1e-12) & (cos > 0))} and np.allclose(s, cos[index.ids[at]])
    # Weights of the groups whose common words a text lacks are not read.
    t, n = next((t, n) for t, n, _ in queries if len(t) > 50)
    want, lacks = index.nearest(t, n, 10), [g for g in range(len(index.held)) if not (index.place[g, index.slot[t]] >= 0).any()]
    for g in lacks:
        index.held[g][:] = np.nan
    got = index.nearest(t, n, 10)
    assert sum(index.held[g].shape[1] for g in lacks) > 1000 and np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_terms_of_many_texts_at_once(monkeypatch):
    """Terms and counts by hashes of many texts at once are those of each text's words and stems."""
    texts = ["", "!!", "a", "ABCDEFGH abcdefgh abcde abcde-", "İstanbul ΣΑΣ Σ", "x" * 1000 + "_1 x", "中文 字\n中文", "", "x²½ é e\u0301", "\U0001d400b\u200bc\x00d", "Straße STRASSE"]
    names = sorted({t for x in texts[1:-1] for t in toxicity.terms(x)})
    assert all(bool(toxicity._WORDS(chr(c))) == toxicity._letters()[c] for c in range(0x110000))
    for chunk in (1, 30, 1 << 18):
        monkeypatch.setattr(toxicity.Terms, "CHUNK", chunk)
        known = pickle.loads(pickle.dumps(toxicity.Terms(toxicity.hashed(pa.array(names)))))
        for text, (t, n) in zip(texts, known.each(texts), strict=True):
            want = Counter(x for x in toxicity.terms(text) if x in names)
            assert {names[i]: k for i, k in zip(t.tolist(), n.tolist(), strict=True)} == want and sorted(t.tolist()) == t.tolist()
    assert [len(t) for t, _ in toxicity.Terms(np.zeros(0, np.uint64)).each(texts)] == [0] * len(texts)


def test_index_is_prepared_in_little_memory():
    """Above what it keeps, an index takes a bounded amount of memory while it is made, not several times its postings."""
    rng = np.random.default_rng(9)
    n, each, size = 4000, 400, 50_000
    terms = np.concatenate([np.sort(rng.choice(size, each, replace=False)) for _ in range(n)]).astype(np.int32)
    index = toxicity.Index(np.arange(n), np.zeros(n), np.arange(0, n * each + 1, each), terms, np.ones(n * each, np.int32), np.ones(size))
    tracemalloc.start()
    index._prepare()
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert now < 20 * n * each and peak - now < 20 * n * each


def test_warc(spark, tmp_path):
    html = "<html lang=\"en\"><title>A &amp; B</title><script>x<1</script><p>One  two<br>three</p><a class=c href=\"http://x/\">l</a><!-- c --></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, "k"), (2, None, None, "k"), (None, "u", "", "k"), (1, "http://a/", html, "k"), (3, "http://b/", "é<p>x" * 5000, None)], "page_id long, url string, html string, key string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 10
    one = {r["record_type"]: r for r in rows if r["key"] == 1}
    assert one["conversion"]["block"] == "A & B\nOne two\nthree\nl" and one["metadata"]["block"].startswith("title: A &amp; B\r\nlanguage: en\r\nhttp: HTTP/1.1 200 OK\r\n")
    assert "outlink: http://x/\r\n" in one["metadata"]["block"] and one["conversion"]["refers_to"] == one["metadata"]["refers_to"] != one["metadata"]["record_id"]
    path = f"file://{tmp_path}/warc"
    records = warc.derivatives(warc.responses(pages))
    assert warc.write_warc(records, path) == 10
    back = {(r["record_id"], r["refers_to"], r["block"]) for r in warc.read_warc(spark, path).collect()}
    assert back == {(r["record_id"], r["refers_to"], r["block"]) for r in rows}
    assert warc.report(pages.limit(0)).count() == 0


def test_warc_text_is_what_its_patterns_say():
    def plain(page):
        for pattern, put in warc.TO_TEXT:
            page = re.sub(pattern.replace(r"\z", r"\Z"), put, page, flags=re.ASCII)
        page = html.unescape(page.replace("&nbsp;", " "))
        for pattern, put in warc.SQUEEZE:
            page = re.sub(pattern, put, page)
        return page.strip(" \n")

    rng = random.Random(3)
    parts = ["<p>", "</div>", " ", "  ", "\n", "\t", "\r\n", "\f", "\x0b", "\xa0", "&nbsp;", "&#160;", "a", "ſ", "<b", "<script>", "</script >", "<!--", "-->", "<p", ">", "<STYLE x>", "&amp;lt;", "&#10;", "&Tab;"]
    for page in ["", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(5000))]:
        assert warc.text_of(page) == plain(page)


def test_warc_references_and_quotings(spark):
    text = "&copy; &middot; &eacute;t&eacute; &#233;&#xE9; &amp;lt; &hellip; &notit; AT&T &#0; &lt;b&gt;"
    page = f"<html lang = 'fr'><a href='http://x/'>{text}</a><a class=c href = http://y/z>.</a><a href=\"http://w/\">.</a><a data-href='no'>.</a></html>"
    rows = {r["record_type"]: r["block"] for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()}
    assert rows["conversion"] == html.unescape(text) + "..."
    assert "language: fr\r\n" in rows["metadata"] and [x for x in rows["metadata"].split("\r\n") if x.startswith("outlink")] == ["outlink: http://x/", "outlink: http://y/z", "outlink: http://w/"]


def test_mixing(spark, odd, empty):
    rng = random.Random(9)
    kinds = {"high": lambda: " ".join(f"calm{rng.randrange(50)} reads well." for _ in range(30)), "low": lambda: " ".join(f"BUY!! {rng.randrange(9)}$$$" for _ in range(30)), "toxic": lambda: " ".join(f"brute{rng.randrange(3)} yells" for _ in range(30))}
    rows = [(k, kinds[d](), d) for k, d in enumerate(["high"] * 60 + ["low"] * 90 + ["toxic"] * 50)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, int(d == "high"), int(d == "toxic")) for i, _, d in rows if i % 2] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    goal = {"high": 0.5, "low": 0.3, "toxic": 0.2}
    got = mixing.document_rates(docs, labels, targets=goal).collect()
    total = sum(r["n_tokens"] for r in got)
    for d, share in goal.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / total - share) < 1e-3
    # The same iterates with all documents at once.
    p, tau = np.array([[r[f"p_{d}"] for d in goal] for r in got]), np.array([float(r["n_tokens"]) for r in got])
    white = np.linalg.pinv((p * tau[:, None]).T @ p / total, rcond=1e-9)
    r = y = np.ones(len(got))
    t, want = 1.0, np.array(list(goal.values()))
    while np.abs((r * tau) @ p / total - want).max() > 1e-4:
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        new = np.maximum(0, y - p @ (white @ ((y * tau) @ p / total - want)))
        y, r, t = new + (t - 1) / after * (new - r), new, after
    assert np.allclose([x["rate"] for x in got], r)
    out = mixing.mixed(odd, labels)
    assert out.columns == odd.columns and mixing.document_rates(odd, labels).count() == odd.count()
    assert mixing.mixed(empty, labels).count() == 0 and mixing.document_rates(empty, labels.limit(0)).count() == 0


def test_pipeline_drops_only_rejected_rows(spark):
    """Rows without an id, or with a shared one, are judged each by itself."""
    rng = random.Random(12)
    rows = [(k, _text(lang, rng), lang, "s") for k, lang in enumerate(list(WORDS) * 20)]
    clean = [(None, _text("en", rng), "en", "s"), (None, _text("de", rng), "de", None), (3, _text("fr", rng), "fr", "t")]
    bad = [(None, "", None, "s"), (None, None, None, None), (3, "12 !!", None, "s"), (7, "", None, "t")]
    docs = spark.createDataFrame(rows + clean + bad, "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.language(spark, docs, SF).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, rows + clean))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k + 1 == len(corpus_pipeline.STAGES) or seen[-1].columns == columns
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in seen]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(ids[1]) == {i for i, t in texts.items() if any(c.isalpha() for c in t)}

    def shingles(t):
        import re

        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: shingles(texts[i]) for i in ids[1]}
    low = {i: i for i in sets}
    for _ in range(8):
        for i in sets:
            for j in sets:
                if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                    low[i] = low[j] = min(low[i], low[j])
    assert sorted(ids[2]) == sorted(i for i in sets if low[i] == i)
    assert sorted(ids[3]) == sorted(ids[2]) and set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])
    clean = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert all("@" not in clean[i] or "@" in texts[i] for i in clean) and not any("example.com" in t and "@mail" in t for t in clean.values())


def test_warc_files(spark, tmp_path):
    """Responses from files: HTTP head apart from payload, other charsets, bytes that are no text, very long pages that never close a tag."""
    import gzip

    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n"
    bodies = {"a": head + "<p>caf\xe9</p>".encode("latin-1"), "b": b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe<p>x</p>", "c": b"HTTP/1.1 204 No Content", "d": head + b"<script>" * 20_000, "e": head + b"<p>" + b"<!-- " * 20_000, "f": head + b"<a href=" * 20_000}
    out = b"".join(gzip.compress(warc.record_bytes(("response", f"<urn:uuid:{k}>", None, "http://x/", "2024-01-01T00:00:00Z", "application/http; msgtype=response", None, k, None), v)) for k, v in bodies.items())
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(out + gzip.compress(warc.record_bytes(("warcinfo", "<urn:uuid:i>", None, None, None, "application/warc-fields", None, None, None), b"software: x\r\n")))
    records = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert records.count() == 7
    got = {(r["key"], r["record_type"]): r for r in warc.derivatives(records.where("record_type = 'response'")).collect()}
    assert got["a", "conversion"]["block"] == "caf\xe9" and got["b", "conversion"]["block"] == "��\nx" and got["c", "conversion"]["block"] == got["d", "conversion"]["block"] == ""
    import hashlib

    for k, v in bodies.items():
        payload = v.partition(b"\r\n\r\n")[2]
        assert got[k, "metadata"]["source_digest"] == f"sha256:{hashlib.sha256(payload).hexdigest()}" and got[k, "metadata"]["refers_to"] == f"<urn:uuid:{k}>"
    assert "http: Content-Type: text/html; charset=ISO-8859-1\r\n" in got["a", "metadata"]["block"]
    broken = bytearray(warc.record_bytes(("response", "<urn:uuid:z>", None, "u", None, "application/http", None, None, None), b"HTTP/1.1 200 OK\r\n\r\nbody"))
    broken[-6] ^= 1
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.warc.gz").write_bytes(gzip.compress(bytes(broken)))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, f"file://{tmp_path}/v").collect()


def test_language_posterior_by_hand(spark):
    """Every posterior against the same sums in plain Python: likelihood, declared language, suffix and shrunken host priors."""
    rng = random.Random(21)
    train = spark.createDataFrame([(k, _text(lang, rng), lang) for k, lang in enumerate(list(WORDS) * 30)], "i long, t string, l string")
    langs, model = language_id.fit(train, "t", "l", "i")
    pages = [(k, f"<html lang={rng.choice(list(WORDS))}>{_text(rng.choice(list(WORDS)), rng, 3)}", f"http://{rng.choice('ab')}.site{k % 2}.{rng.choice(['fr', 'de'])}/") for k in range(40)] + [(90, "<p>12</p>", None), (91, None, "http://b.site1.de/")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, html string, url string"), langs, model, "page_id", "html", url_col="url", markup=True).collect()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    rows = {}
    for k, page, url in pages:
        text = html.unescape(language_id._SKIP.sub(" ", page or ""))
        grams = language_id.trigrams(text)
        ll = model.T[grams].sum(0, dtype=float) * 0.2 if len(grams) else np.zeros(3)
        host = (url or "//").split("/")[2]
        declared = language_id.declared_in(page or "") or ""
        rows[k] = (ll - ll.max(), softmax(ll) if len(grams) else np.full(3, 1 / 3), declared, host.split(".")[-1], host, ".".join(host.split(".")[-2:]), len(grams))
    total = sum(r[1] for r in rows.values())
    overall = (total + 1) / (total.sum() + 3)

    def given(at):
        table = {}
        for r in rows.values():
            if r[at]:
                table[r[at]] = table.get(r[at], 0) + r[1]
        sums = sum(table.values())
        return {v: np.log((c + 0.5) / (sums + 0.5 * (len(table) + 1))) for v, c in table.items()}, table

    (declared, _), (suffix, _), (_, hosts), (_, domains) = given(2), given(3), given(4), given(5)
    for k, (ll, soft, d, s, h, dom, n) in rows.items():
        less = lambda table, key, soft=soft: np.maximum(table[key] - soft, 0) if key else np.zeros(3)
        up = (less(domains, dom) + 5 * overall) / (less(domains, dom).sum() + 5)
        prior = (less(hosts, h) + 5 * up) / (less(hosts, h).sum() + 5)
        post = softmax(np.log(prior) + ll + declared.get(d, 0) + suffix.get(s, 0))
        assert abs(got[k]["posterior"] - post.max()) < 1e-9, k
        rejected = post.max() < 0.5 or n == 0 and not d
        assert got[k]["rejected"] == rejected and (rejected or got[k]["lang"] == langs[int(post.argmax())])


def test_markup_scanning_is_linear():
    import time

    for tag in ("<script ", "<!-- ", "<style>", "<", "<meta content-language "):
        began = time.perf_counter()
        assert language_id.declared_in(tag * 100_000) is None
        language_id._SKIP.sub(" ", tag * 100_000)
        assert time.perf_counter() - began < 5, tag


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_mixing_posteriors_on_held_out_labels(spark):
    """Posteriors fitted without a fifth of the labels say more of it than the shares of the domains do, and rank toxic texts first."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5)) == 0
    rows = mixing.document_rates(docs, labels.where(~held), rounds=1).join(labels.where(held).withColumn("d", mixing.label_domain()), "doc_id").collect()
    share = {d: sum(r["d"] == d for r in rows) / len(rows) for d in mixing.DOMAINS}
    assert np.mean([np.log(max(r[f"p_{r['d']}"], 1e-9)) for r in rows]) > np.mean([np.log(share[r["d"]]) for r in rows]) + 0.1
    p, y = np.array([r["p_toxic"] for r in rows]), np.array([r["d"] == "toxic" for r in rows])
    auc = (p[y][:, None] > p[~y][None, :]).mean() + (p[y][:, None] == p[~y][None, :]).mean() / 2
    assert auc > 0.8
