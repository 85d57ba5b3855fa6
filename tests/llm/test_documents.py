"""The operators on documents: odd rows, empty tables, and plain versions of what they compute."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, media, packing, pii, substring_dedup
from tessera.llm.jaccard_join import WIDTH, one_of_each, similarity_join
from tessera.llm.shared import mix
from tessera.llm.suffix_array import permuted_prefixes, suffix_array

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def collect(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_jaccard_join(spark, odd, empty):
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(200)]
    many = []
    for k in range(60):  # near copies around the threshold, and a shared passage in unlike texts
        words = list(base) if k < 40 else [f"u{k}_{j}" for j in range(100)] + base[:40]
        for j in rng.choice(len(words), rng.integers(0, 8), replace=False):
            words[j] = f"x{k}_{j}"
        many.append((100 + k, " ".join(words)))
    docs = odd.select("doc_id", "text", "kept", "n").unionByName(spark.createDataFrame([(*m, "k", 1) for m in many], "doc_id long, text string, kept string, n long"))
    rows = collect(docs)

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    key = lambda i: -(2**63) if rows[i][0] is None else rows[i][0]
    want = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        low = min(map(key, seen))
        want.append((key(i), low, len(links[i])))
    null = lambda v: -(2**63) if v is None else v
    got = [(null(r["doc_id"]), null(r["class_id"]), r["n_links"]) for r in similarity_join(docs, leaf=8, depth=2, block=8).collect()]
    assert sorted(got) == sorted(want)
    assert similarity_join(empty).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, [1, 3, 4, None, 5, 8, 9, 10]))


def test_jaccard_recall_in_large_buckets(spark):
    """2,000 pairs at similarity 0.8 whose coordinates take four values each, so that every root bucket holds about 1,000 sets."""
    least = jaccard_join.least_common(0.9999, 0.8, 0.2)
    roots = jaccard_join.roots_for(0.9999, 0.8, 4, least)
    assert jaccard_join.missed(roots, 0.8, 4, least) <= 1e-4 < jaccard_join.missed(roots - 1, 0.8, 4, least)
    rng = np.random.default_rng(13)
    first = rng.integers(0, 4, (2000, jaccard_join.WIDTH))
    other = np.where(rng.random(first.shape) < 0.8, first, (first + rng.integers(1, 4, first.shape)) % 4)
    sketch = np.stack([first, other], 1).reshape(4000, -1).astype(np.uint16)
    paths = mix(sketch[:, :roots].astype(np.uint64) + np.arange(roots, dtype=np.uint64) * np.uint64(4097)).astype(np.int64)
    rows = [(i, bytearray(sketch[i].tobytes()), paths[i].tolist()) for i in range(4000)]
    classes = spark.createDataFrame(rows, "cid long, sketch binary, paths array<long>")
    edges = {tuple(sorted(e)) for e in jaccard_join.candidates(classes, 0.8, 32, 4, least).collect()}
    assert sum((i, i + 1) not in edges for i in range(0, 4000, 2)) <= 2  # 0.2 expected at the recall of 0.9999


def test_jaccard_splits_move_only_their_sketches(spark):
    """Twenty sets of 2,000 share a bucket: the other sketches are read for the first buckets only, not at every split."""
    read = spark.sparkContext.accumulator(0)
    sketch = np.random.default_rng(4).integers(0, 2**16, (2000, WIDTH)).astype(np.uint16)
    sketch[:20] = sketch[0]
    rows = [(i, bytearray(s.tobytes()), mix(s[:4].astype(np.uint64) + np.arange(4, dtype=np.uint64) * np.uint64(4097)).astype(np.int64).tolist()) for i, s in enumerate(sketch)]

    @F.udf("binary")
    def counted(sketch):
        read.add(1)
        return sketch

    classes = spark.createDataFrame(rows, "cid long, sketch binary, paths array<long>").withColumn("sketch", counted("sketch"))
    edges = {tuple(sorted(e)) for e in jaccard_join.candidates(classes, 0.8, 8, 4, 38).collect()}
    assert edges == {(0, i) for i in range(1, 20)}
    assert read.value <= 2 * len(rows)


def test_pii(odd, empty):
    got = {(r["doc_id"]): r for r in pii.report(odd).collect()}
    assert (got[8]["n_email"], got[8]["n_ip"], got[8]["n_phone"], got[8]["n_card"]) == (1, 1, 1, 0)
    assert got[9]["spans"] == "email:10:16" and got[3]["base_sha256"] == got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.report(odd).count() == odd.count() and pii.report(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(odd).collect()}
    assert clean[8] == "mail [email], [ip] and [phone] ext" and clean[3] is None and clean[9] == "¡! ?? \U0001f600 \U0001f600 [email]" and pii.sanitised(odd).columns == odd.columns


def test_pii_patterns(spark):
    """Every base span against the published patterns as Python has them."""
    pieces = ["a@b.co", "a@b@c.d.e", "x.y_z%1@h-1.org.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111 1111--1111", "49927398716" * 2, "+1 (555) 555-0100)", "+12", "++44 20 7946 0958 12", "1" * 40, "@", "é4111111111111111é", "+1.2.3.4.5.6.7.8.9.0"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(pieces, 4)) for _ in range(60)] + ["".join(rng.choice(pieces, 3)) for _ in range(60)] + pieces
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs, threshold=9.0).collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    fine = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(plain.items()) for m in re.finditer(p, t) if fine[kind](m[0]))
        assert got[i] == ",".join(x[2] for x in found), t


def test_pii_disclosure(spark):
    """A rare word that stands with one entity in different surroundings gives it away; a common word and clean texts do not."""
    rows = [(k, f"report {k} says zanzibar met ann@corp.example on day {k} about the plan") for k in range(6)] + [(100 + k, f"the plan of day {k} was fine and the team met about it") for k in range(300)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {rows[i][1][int(s.split(":")[1]) : int(s.split(":")[2])] for i in range(6) for s in got[i]["spans"].split(",") if s.startswith("term")}
    assert "zanzibar" in words and not words & {"the", "plan", "day", "met", "about"} and all(got[100 + k]["spans"] == "" for k in range(300))
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zanzibar" not in text[0] and "[email]" in text[0] and text[100] == rows[6][1]


def test_pii_terms_of_whole_texts(spark):
    """A word that only accompanies an entity from afar is found, and goes from every text, far from entities and without them too."""
    far = " ".join(["the plan of the day was fine"] * 10)
    rows = [(k, f"Zanzibar {far} note {'abcdef'[k] * 3} ann@corp.example met {'uvwxyz'[k] * 3}") for k in range(6)]
    rows += [(100 + k, f"the plan of day {k} was fine and the team met about a note") for k in range(300)] + [(900, "we saw zanzibar and its plan")]
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [i for i, t in got.items() if "zanzibar" in t.lower()] and got[900].endswith(" and its plan")
    assert all(far in got[k] and "[email]" in got[k] for k in range(6)) and got[100] == rows[6][1]


def test_substring_dedup(spark, odd, empty):
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdé "), 260))
    extra = [(200 + k, "".join(rng.choice(list("xyz "), 150)) + passage[k : k + 180] + "".join(rng.choice(list("uvw "), 90))) for k in range(30)] + [(300, "ab" * 400), (301, "q" * 99), (302, "q" * 100), (303, "q" * 350)]
    docs = odd.select("doc_id", "text", "id", "spans", "kept", "f").unionByName(spark.createDataFrame([(*e, "i", "s", "k", 1) for e in extra], "doc_id long, text string, id string, spans string, kept string, f int"))
    rows = sorted(set(collect(docs)), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        flag = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                flag[s : s + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, x in zip(b, flag, strict=True) if not x)
        want[i] = (len(b), sum(flag), len(re.findall(b"\1+", bytes(flag))), hashlib.sha256(left).hexdigest())
    for shard in (1 << 16, 64):  # the small one sends every fingerprint by its windows
        got = substring_dedup.deduplicate(docs, shard_bytes=shard).collect()
        assert len(got) == docs.count() and all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert substring_dedup.deduplicate(empty).count() == 0


def test_substring_sorts_only_what_may_repeat(monkeypatch):
    """Pieces that share their k-gram alone are not sorted; of those that share more, the windows around it are."""
    rng = np.random.default_rng(21)
    sorted_symbols = []
    real = substring_dedup.suffix_array
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda s, k: sorted_symbols.append(len(s)) or real(s, k))
    pieces = [bytearray(rng.integers(97, 123, 138).astype(np.uint8).tobytes()) for _ in range(40)]
    for p in pieces[1:38]:
        p[50:74] = pieces[0][50:74]
    pieces[39][10:130] = pieces[38][10:130]
    n = len(pieces)
    columns = {"f": [1] * 38 + [2] * 2, "id": list(range(n)), "th": [0] * n, "start": [1000] * n, "piece": [bytes(p) for p in pieces], "inner": [50] * n, "lo": [0] * n, "hi": [77] * n, "shard": [0] * n}
    table = pa.table({k: pa.array(v, pa.binary() if k == "piece" else pa.int64()) for k, v in columns.items()})
    got = [r for b in substring_dedup._in_shards(table, 100) for r in b.to_pylist()]
    assert got == [{"id": 39, "th": 0, "start": 1010, "stop": 1130}]
    assert sum(sorted_symbols) <= 2 * 139


@pytest.mark.parametrize("k", [2, 5, 257])
def test_suffix_array(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 2, 7, 60, 300):
        for _ in range(10):
            s = rng.integers(0, k, n)
            t = list(s)
            order = suffix_array(s, k)
            assert list(order) == sorted(range(n), key=lambda i: t[i:])
            if n > 1:
                common = permuted_prefixes(s, order, 8)
                for a, b in zip(order[:-1], order[1:], strict=True):
                    same = next((j for j in range(n) if b + j >= n or a + j >= n or t[a + j] != t[b + j]), n)
                    assert (common[b] >= 8) == (same >= 8)


def test_media(odd, empty, tmp_path):
    got = media.media_features(odd, archive_bytes=2000).collect()
    assert len(got) == odd.count()
    texts = {}
    for i, t in collect(odd):
        texts.setdefault(i, t or "")
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        wav = media.to_wav(raw)
        assert r["media_sha256"] == hashlib.sha256(wav).hexdigest() and media.from_wav(wav) == (len(raw), payload) and r["media_bytes"] == len(wav) and r["feature"] == media.feature(payload)
    assert media.media_features(empty).count() == 0


def test_media_ranges_and_errors(spark, odd, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store(odd.coalesce(1), path, "doc_id", "text", 1 << 20)
    whole = {(r["member"], r["offset"]) for r in media.members(spark, path).collect()}
    small = [(r["member"], r["offset"]) for r in media.members(spark, path, splitbytes=100, batchbytes=50).collect()]
    assert sorted(small) == sorted(whole) and len(whole) == odd.count()
    archive = next(tmp_path.glob("m/*.zip"))
    data = bytearray(archive.read_bytes())
    data[60:64] = b"\xff\xff\xff\xff"  # within the first member
    archive.write_bytes(data)
    rows = media.members(spark, path, attempts=2).collect()
    assert len(rows) == odd.count() and sum(r["error"] is not None for r in rows) == 1


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for chunk in (100_000, 2):
        rows = packing.pack(odd, TOKENIZER, capacity=64, chunk=chunk).collect()
        want = sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in collect(odd))
        by, sequences = {}, {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r)
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts = dict(collect(odd))
        for i, found in by.items():
            copies = sum(str(i) == w[0] for w in want)
            ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
            assert sum(r["length"] for r in found) == copies * len(ids) and len(found) == copies * -(-len(ids) // 64)
            assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in found)
        for places in sequences.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 64  # noqa: B905
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_bin_completion():
    """Against exhaustive search on small problems, and within the bound on larger ones."""
    rng = np.random.default_rng(11)

    def fewest(items, room):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b + items[k] <= room:
                    rest = list(bins)
                    rest.remove(b)
                    go(k + 1, [*rest, b + items[k]])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best[0]

    for _ in range(25):
        items = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        plan = packing.complete(counts, 20)
        assert sum(t for _, t in plan) == fewest(items, 20) >= packing.lower_bound(counts, 20)
        used = np.zeros(21, int)
        for filling, times in plan:
            assert sum(filling) <= 20
            used += np.bincount(filling, minlength=21) * times
        assert (used == counts).all()
    counts = np.bincount(rng.integers(1, 1000, 5000), minlength=1025)
    assert sum(t for _, t in packing.complete(counts, 1024)) <= 1.01 * packing.lower_bound(counts, 1024)


def test_word_ids():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    for text in ["", " ", "a  b\n\n c\t d ", "don't  stop!!\r\n", "é ü　x", "<|endoftext|> x", "123 4.5\n \n", "a  b", " lead", "trail \n"]:
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_substring_lengths(spark):
    """Brute force at lengths around and below the k-gram's, and over a shard whose recursion is deep."""
    rng = np.random.default_rng(17)
    passage = "".join(rng.choice(list("abcdefgh "), 300))
    rows = [(k, "".join(rng.choice(list("xyz "), 60)) + passage[3 * k : 3 * k + 102 + k] + "".join(rng.choice(list("uvw "), 50))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (7, 24, 101, 102):
        seen, want = set(), {}
        for i, t in rows:
            b = t.encode()
            flag = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if b[s : s + length] in seen:
                    flag[s : s + length] = b"\1" * length
                seen.add(b[s : s + length])
            want[i] = (sum(flag), hashlib.sha256(bytes(c for c, x in zip(b, flag, strict=True) if not x)).hexdigest())
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(docs, length=length).collect()}
        assert got == want, length
        assert length > 101 or sum(n for n, _ in want.values()) > 0


def test_suffix_array_recurses_over_wide_alphabets():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 4, 3000)
    s = np.concatenate([word, rng.integers(0, 4, 3000), word[500:], rng.integers(0, 4, 100), word[:2000]])
    order = suffix_array(s, 4)
    t = s.astype(np.uint8).tobytes()
    assert list(order) == sorted(range(len(s)), key=lambda i: t[i:])
    wide = rng.integers(0, 100_000, 2000)
    assert list(suffix_array(wide, 100_000)) == sorted(range(2000), key=lambda i: wide[i:].tolist())
    common = permuted_prefixes(s, order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = common[b]
        assert t[a : a + n] == t[b : b + n] and t[a + n : a + n + 1] != t[b + n : b + n + 1]
