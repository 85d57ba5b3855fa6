"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index of all their terms."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import id_back, long_id, mix, written

_WORDS = re.compile(r"\w+").findall
STEM = 5
BLOCK = 64
GROUPS = 8
COMMON = 16  # a term of more than one in so many of a group's examples is held by example, not by posting
BATCH = 256  # texts of one group that are searched together
CHUNK = 1 << 18  # postings that are prepared at once
SLACK = 1e-5  # more than single precision loses; whatever is that close is decided in double


def terms(text: str) -> list[str]:
    """Lower-cased words of a whole text, and the stems (first letters, with a dash) of the longer ones."""
    words = _WORDS(text.lower())
    return words + [w[:STEM] + "-" for w in words if len(w) > STEM]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points \\w matches."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)


def _coded(c: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """A code point at a place of its term as 64 bits; those of a term add up to its hash."""
    return mix(c.astype(np.uint64) + (np.asarray(place).astype(np.uint64) << np.uint64(21)) + np.uint64(0x9E3779B97F4A7C15))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(names: pa.Array) -> np.ndarray:
    """The hash of each term. A term may hold a dash, but no line end."""
    out = np.zeros(len(names), np.uint64)
    for lo in range(0, len(names), 4096):
        some = names.slice(lo, 4096).to_pylist()
        size = np.array([len(x) + 1 for x in some])
        first = np.r_[0, np.cumsum(size)[:-1]]
        h = _coded(np.append(_points(some), np.uint32(10)), np.arange(size.sum()) - np.repeat(first, size))
        ends = first + size - 1
        h[ends] = 0
        out[lo : lo + len(some)] = np.add.reduceat(h, first)
    return out


class Terms:
    """Numbers of known terms, and how often a text has each. Terms are met by 64 bits of their hashes, many texts at once."""

    CHUNK = 1 << 20  # characters of texts that are cut into words together

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms, ascending, and their counts."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text.lower())
            size += len(some[-1])
            if size >= self.CHUNK:
                out += self._some(some)
                some, size = [], 0
        return out + (self._some(some) if some else [])

    def _some(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        c = _points(texts)
        letter = np.zeros(len(c) + 2, bool)
        letter[1:-1] = _letters()[c]
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        own = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), begin, side="right")
        first = np.cumsum(size) - size
        h = _coded(c[letter[1:-1]], np.arange(size.sum()) - np.repeat(first, size))
        long = np.flatnonzero(size > STEM)
        stems = np.full(len(long), _coded(np.array([ord("-")]), STEM)[0])
        for k in range(STEM):
            stems += h[first[long] + k]
        found, at = np.unique(np.concatenate([np.add.reduceat(h, first) if len(h) else h, stems]), return_inverse=True)
        where = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        known = self.hashes[where] == found if len(self.hashes) else np.zeros(len(found), bool)
        numbers = np.where(known, self.order[where], -1) if len(self.hashes) else np.full(len(found), -1)
        t, of = numbers[at].astype(np.int64), np.concatenate([own, own[long]])
        both = np.sort((of[t >= 0] << 32) + t[t >= 0])
        head = np.flatnonzero(np.diff(both, prepend=-1))
        n, both = np.diff(head, append=len(both)).astype(np.int32), both[head]
        t, cuts = (both & 0xFFFFFFFF).astype(np.int32), np.searchsorted(both, np.arange(len(texts) + 1) << 32).tolist()
        return [(t[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def grouped(examples: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each example, common terms, a centre over them per group): texts that use the same common words, as those of one language do.

    Spherical k-means of a few thousand examples; every example goes to its nearest centre. Groups only steer the search.
    """
    n = len(examples)
    many = min(GROUPS, n // (16 * BLOCK))
    df = np.zeros(size, np.int64)
    for e in examples:
        df[np.asarray(e[2], np.int64)] += 1
    common = np.flatnonzero(df > n / COMMON)
    if many < 2 or not len(common):
        return np.zeros(n, np.int64), common, np.zeros((1, len(common)), np.float32)
    place = np.full(size, -1)
    place[common] = np.arange(len(common))

    def vectors(some: range) -> np.ndarray:
        x = np.zeros((len(some), len(common)), np.float32)
        for i, j in enumerate(some):
            at = place[np.asarray(examples[j][2], np.int64)]
            x[i, at[at >= 0]] = 1 + np.log(np.asarray(examples[j][3])[at >= 0])
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
        return x

    # einsum takes no buffers of BLAS: the driver, where this runs, has little memory to spare.
    cosines = lambda x, y: np.einsum("ij,gj->ig", x, y)
    x = vectors(range(0, n, -(-n // 4096)))
    centres = x[np.random.default_rng(0).choice(len(x), 1)]
    while len(centres) < many:  # the text that is farthest from all centres, one percent of outliers aside
        far = cosines(x, centres).max(1)
        centres = np.r_[centres, x[[np.argsort(far, kind="stable")[len(x) // 100]]]]
    for _ in range(8):
        near = cosines(x, centres).argmax(1)
        centres = np.array([x[near == g].sum(0) if (near == g).any() else centres[g] for g in range(many)], np.float32)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.concatenate([cosines(vectors(range(lo, min(lo + 1024, n))), centres).argmax(1) for lo in range(0, n, 1024)]), common, centres


class Index:
    """Labelled examples in groups of blocks: per term its postings, and its largest weight in each block; and each example's terms.

    Only the examples' terms and counts travel; the postings are made from them where the index is first used.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, steer: tuple | None = None):
        self.ids, self.labels, self.starts, self.terms, self.counts, self.idf = ids, labels, starts, terms, counts, idf
        self.steer = steer or ([len(ids)], np.zeros(0, np.int64), np.zeros((1, 0), np.float32))  # sizes of groups, common terms, centres
        self.ready = False

    def _prepare(self) -> None:
        n, size, total = len(self.ids), len(self.idf), len(self.terms)
        parts = [slice(lo, lo + CHUNK) for lo in range(0, total, CHUNK)]  # what is made on the way stays small
        rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        blocks = -(-n // BLOCK)
        cuts = np.minimum(np.cumsum([0, *self.steer[0]]) // BLOCK, blocks)  # a block belongs to one group
        cuts[-1] = blocks
        self.cuts = cuts.tolist()
        group = np.repeat(np.arange(len(cuts) - 1, dtype=np.int8), np.diff(cuts) * BLOCK)
        commons = []
        for lo, hi in zip(self.cuts, self.cuts[1:]):  # noqa: B905
            lo, hi = min(lo * BLOCK, n), min(hi * BLOCK, n)
            commons.append(np.flatnonzero(np.bincount(self.terms[self.starts[lo] : self.starts[hi]], minlength=size) > (hi - lo) / COMMON))
        union = np.unique(np.concatenate([*commons, self.steer[1]]))
        self.slot = np.full(size, -1, np.int32)
        self.slot[union] = np.arange(len(union))
        self.place = np.full((len(commons), len(union) + 1), -1, np.int32)  # the last one stands for terms without a slot
        for g, common in enumerate(commons):
            self.place[g, self.slot[common]] = np.arange(len(common))
        self.centres = np.zeros((len(commons), len(union) + 1), np.float32)
        self.centres[:, self.slot[self.steer[1]]] = self.steer[2]
        self.own, norms, df = np.empty(total), np.zeros(n), np.zeros(size, np.int64)
        for on in parts:
            w = 1 + np.log(self.counts[on].astype(float))
            w *= self.idf[self.terms[on]]
            self.own[on] = w
            norms += np.bincount(rows[on], w * w, minlength=n)
            rare = self.place[group[rows[on]], self.slot[self.terms[on]]] < 0
            df += np.bincount(self.terms[on][rare], minlength=size)
        norms = np.sqrt(norms)
        norms[norms == 0] = 1
        self.held = [np.zeros((len(c), (hi - lo) * BLOCK), np.float32) for c, lo, hi in zip(commons, self.cuts, self.cuts[1:], strict=False)]
        self.offsets = np.r_[0, np.cumsum(df)]
        self.postings = np.empty(self.offsets[-1], np.int64)  # an example's number and its weight, 32 bits each: one look for both
        docs, weights = self.postings.view(np.int32)[::2], self.postings.view(np.float32)[1::2]
        free = self.offsets[:-1].copy()  # where the next posting of each term goes
        for on in parts:
            t, row = self.terms[on], rows[on]
            self.own[on] /= norms[row]
            of = group[row]
            at = self.place[of, self.slot[t]]
            for g, held in enumerate(self.held):
                here = (of == g) & (at >= 0)
                held[at[here], row[here] - self.cuts[g] * BLOCK] = self.own[on][here]
            rare = np.flatnonzero(at < 0)
            rare = rare[np.argsort(t[rare], kind="stable")]
            t = t[rare]
            head = np.flatnonzero(np.diff(t, prepend=-1))
            each = np.diff(np.r_[head, len(t)])
            to = np.repeat(free[t[head]] - head, each) + np.arange(len(t))
            docs[to], weights[to] = row[rare], self.own[on][rare]
            free[t[head]] += each
        self.maxima = [x.reshape(len(x), -1, BLOCK).max(2) if x.size else np.zeros((len(x), x.shape[1] // BLOCK), np.float32) for x in self.held]
        self.dense, self.member = np.zeros(size), np.zeros(size, bool)
        self.counts = None
        self.ready = True

    def __reduce__(self):
        return Index, (self.ids, self.labels, self.starts, self.terms, self.counts, self.idf, self.steer)

    @classmethod
    def build(cls, examples: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray) -> Index:
        """examples: (id, label, terms, counts). Examples of a group whose heaviest terms are alike share blocks, so that bounds are tight."""

        def heaviest(e: tuple) -> tuple:
            t = np.asarray(e[2], np.int32)
            return tuple(t[np.lexsort((t, -idf[t]))[:8]].tolist())

        group, common, centres = grouped(examples, len(idf))
        order = sorted(range(len(examples)), key=lambda i: (group[i], heaviest(examples[i]), examples[i][0]))
        examples = [examples[i] for i in order]
        flat = lambda k: np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[k], np.int32) for e in examples)])
        starts = np.cumsum([0, *(len(e[2]) for e in examples)])
        steer = np.bincount(group, minlength=len(centres)).tolist(), common, centres
        counts = flat(3)
        counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))  # mostly one byte each
        return cls(np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float), starts, flat(2), counts, idf, steer)

    def nearest(self, t: np.ndarray, n: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.search([(t, n, without)], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, int | None]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, counts, id left out): (examples, cosines) of the k nearest with any cosine above 0, and all that tie with the last.

        Texts nearest to one group's centre are searched together. Postings of the rarer terms are summed by example; the
        common ones of a group are products with its examples' weights in single precision, and what a block may add by
        them is bounded by its maxima: after the own group, only blocks that may reach the k-th sum so far are looked at.
        What is left within SLACK of the k-th is compared exactly, in double.
        """
        if not self.ready:
            self._prepare()
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not len(self.ids):
            return out
        homes: list[list[int]] = [[] for _ in self.held]
        for i, (t, n, _) in enumerate(queries):
            slots = self.slot[t]
            homes[int((self.centres[:, slots] @ (1 + np.log(n))).argmax())].append(i)
        for home, mine in enumerate(homes):
            for lo in range(0, len(mine), BATCH):
                some = mine[lo : lo + BATCH]
                for i, found in zip(some, self._together([queries[i] for i in some], home, k), strict=True):
                    out[i] = found
        return out

    def _together(self, some: list[tuple[np.ndarray, np.ndarray, int | None]], home: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = self.cuts[-1] * BLOCK
        near, weights = np.empty((len(some), width), np.float32), []
        for i, (t, n, without) in enumerate(some):
            q = (1 + np.log(n)) * self.idf[t]
            weights.append(q / (np.linalg.norm(q) or 1))
            a = self.offsets[t]
            each = self.offsets[t + 1] - a
            at = np.repeat(a - np.cumsum(each) + each, each)
            at += np.arange(len(at))
            found = self.postings[at].view(np.int32)
            near[i] = np.bincount(found[::2], found[1::2].view(np.float32) * np.repeat(weights[i], each), minlength=width)
            if without is not None:
                near[i, : len(self.ids)][self.ids == without] = -2.0  # below whatever the common terms may add
        slots = self.slot[np.concatenate([t for t, _, _ in some])]
        row, flat = np.repeat(np.arange(len(some)), [len(t) for t, _, _ in some])[slots >= 0], np.concatenate(weights)[slots >= 0]
        slots = slots[slots >= 0]
        reach = np.zeros(len(some), np.float32)  # what the k-th reaches at least
        for g in sorted(range(len(self.held)), key=lambda g: g != home):
            at = self.place[g, slots]
            q = np.zeros((len(some), len(self.held[g])), np.float32)
            q[row[at >= 0], at[at >= 0]] = flat[at >= 0]
            part = near[:, self.cuts[g] * BLOCK : self.cuts[g + 1] * BLOCK]
            bound = part.reshape(len(some), -1, BLOCK).max(2) + q @ self.maxima[g]
            able = (bound > 0) & (bound >= reach[:, None] - SLACK)
            on, rows = np.flatnonzero(able.any(0)), np.flatnonzero(able.any(1))
            if not len(on):
                part[:] = -1.0
                continue
            used = np.flatnonzero(q.any(0))
            held = self.held[g]
            if 2 * len(used) < len(held):
                q, held = q[:, used], held[used]
            part[rows] += q[rows] @ held
            part[np.setdiff1d(np.arange(len(some)), rows)] = -1.0
            if part.shape[1] >= k:
                reach = np.maximum(reach, np.partition(part, -k, axis=1)[:, -k])
        for i, (t, _, _) in enumerate(some):
            x = np.flatnonzero((near[i] > 0) & (near[i] >= reach[i] - 2 * SLACK))
            s = near[i, x]
            if len(s) > k:
                x = x[s >= np.partition(s, -k)[-k] - 2 * SLACK]
            yield self._exact(t, weights[i], x, k)

    def _exact(self, t: np.ndarray, q: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[some + 1] - self.starts[some]
        some, sizes = some[sizes > 0], sizes[sizes > 0]
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0)
        self.dense[t], self.member[t] = q, True
        spans = list(map(slice, self.starts[some].tolist(), (self.starts[some] + sizes).tolist()))
        found = np.concatenate([self.terms[x] for x in spans])
        both = np.flatnonzero(self.member.take(found, mode="clip"))  # a byte a term, so most of them stay in a cache
        parts = self.dense[found[both]] * np.concatenate([self.own[x] for x in spans])[both]
        s = np.bincount(np.repeat(np.arange(len(some)), sizes)[both], parts, minlength=len(some))
        self.dense[t], self.member[t] = 0, False
        some, s = some[s > 0], s[s > 0]
        if len(s) > k:
            keep = s >= np.partition(s, -k)[-k] - 1e-12
            some, s = some[keep], s[keep]
        order = np.lexsort((self.ids[some], -np.round(s, 12)))
        return some[order], s[order]

    def votes(self, queries: list[tuple[list[int], list[int], int | None]], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The neighbours' labels weighted by closeness, NaN without neighbours; the neighbours and their cosines."""
        out = []
        for at, s in self.search([(np.asarray(t, np.int64), np.asarray(n, float), without) for t, n, without in queries], k):
            w = 1 / (1.05 - np.minimum(s, 1))
            out.append((float((w * self.labels[at]).sum() / w.sum()) if len(at) else float("nan"), at, s))
        return out


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 8 * BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts' terms are held at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def calibration(raw: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(score without neighbours, knots, values): the labelled share by vote, made monotone by pooling neighbours."""
    some = ~np.isnan(raw)
    base = (label.sum() + 0.5) / (len(label) + 1)
    lone = (label[~some].sum() + 2 * base) / ((~some).sum() + 2)
    order = np.argsort(raw[some], kind="stable")
    x, y = raw[some][order], label[some][order]
    pools: list[list[float]] = []
    for v, n in zip(x, y, strict=True):
        pools.append([v, n, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            total = pools[-1][2] + last[2]
            pools[-1] = [(pools[-1][0] * pools[-1][2] + last[0] * last[2]) / total, pools[-1][1] + last[1], total]
    if not pools:
        return lone, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    knots = np.array([p[0] for p in pools])
    values = np.array([(p[1] + base) / (p[2] + 1) for p in pools])
    return lone, np.r_[-1e-9, knots, 1 + 1e-9], np.maximum.accumulate(np.r_[values[0], values, values[-1]])


def passage(text: str) -> int:
    """Four min-hashes of the three-word shingles as one: equal for copies and most close copies, which are one piece of
    evidence, and unlike for texts that share only a part."""
    w = _WORDS(text.lower())
    shingles = {" ".join(x) for x in zip(w, w[1:], w[2:])} or {text}  # noqa: B905
    h = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in shingles], np.uint64)
    least = [int(mix(h + np.uint64(k << 32)).min()) for k in range(1, 5)]
    return int.from_bytes(hashlib.blake2b(repr(least).encode(), digest_size=8).digest(), "little", signed=True)


def vocabulary(counts: list[tuple[str, int, int]], n: int, positive: int, size: int, chance: float, tested: int) -> list[str]:
    """The terms most associated with the label, at most size of them.

    The log-likelihood ratio must exceed what `chance` false finds among all tested terms would allow.
    """
    if not counts or not 0 < positive < n:
        return []
    names = [c[0] for c in counts]
    a, b = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / e), 0)
    p = positive / n
    g = 2 * (part(a, (a + b) * p) + part(b, (a + b) * (1 - p)) + part(positive - a, (n - a - b) * p + 1e-9) + part(n - positive - b, (n - a - b) * (1 - p) + 1e-9))
    order = sorted(np.flatnonzero(g >= 2 * np.log(max(tested, 2) / chance)), key=lambda k: (-g[k], names[k]))
    return [names[k] for k in order[:size]]


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000,
    size: int = 2048, chance: float = 0.1, k: int = 25, evidence: int = 3, stress: float = 8.0,
) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, evidence (ids of the nearest examples), similarity.

    Examples are labelled rows whose crc32(id as text) mod 5 is not 0, at most max_labelled of them (those whose id has
    the smallest hash). They are indexed over all their terms; those chosen for their association with the label, copies
    counted once, weigh `stress` times their IDF. Votes are calibrated with each example's own label left out. Document
    frequencies are counted over all of docs; every whole text is scored, by its terms that any example has.
    Texts without such a term, null and empty ones among them, get the examples' share of that kind. With no usable
    labels every score is 0.5 at most the base rate (no example: 0). Null labels and ids of labels are passed over; a
    null id of docs stays null and is not held out; repeated rows are scored alike; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    held = lambda c: F.coalesce(F.pmod(F.crc32(F.encode(F.col(c).cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(False))
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id IS NOT NULL AND __label IS NOT NULL").where(~held("__id"))
    usable = usable.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id")).limit(max_labelled)
    examples = written(usable, "examples")  # at most max_labelled rows of 12 bytes: bounded, so it is broadcast
    texts = docs.select(long_id(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, zeros, names = Counter(), Counter(), set()
        for batch in batches:
            for text, label, once in zip(batch.column("__text"), *(batch.column(x).to_pylist() for x in ("__label", "once")), strict=True):
                found = set(terms(text.as_py()))
                if once:
                    (ones if label else zeros).update(found)
                else:
                    names |= found
        names = list(names | ones.keys() | zeros.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ones[x] for x in names], pa.int64()), pa.array([zeros[x] for x in names], pa.int64())], ["term", "a", "b"])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array([passage(t.as_py()) for t in batch.column("__text")], pa.int64())], ["__id", "__label", "passage"])

    labelled = texts.join(F.broadcast(examples), "__id")
    single = labelled.mapInArrow(passages, "__id long, __label int, passage long").groupBy("passage", "__label").agg(F.min("__id").alias("__id"))
    single = written(single.select("__id", "__label").distinct(), "single")  # no more rows than examples
    seen = single.agg(F.count("*"), F.sum(F.when(F.col("__label") > 0, 1))).first()
    n, positive = seen[0], seen[1] or 0
    once = labelled.join(F.broadcast(single.withColumn("once", F.lit(True))), ["__id", "__label"], "left").select("__text", "__label", F.coalesce("once", F.lit(False)).alias("once"))
    counted = once.mapInArrow(frequencies, "term string, a long, b long")
    counted = written(counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "frequencies")
    # Only terms that lean towards one label come to the driver, a bounded number of them.
    expected = (F.col("a") + F.col("b")) * F.lit(positive / max(n, 1))
    lean = (F.col("a") - expected) ** 2 / (expected + F.lit(0.5))
    top = counted.where("a + b >= 3").orderBy(lean.desc(), "term").limit(4 * size).collect()
    chosen = vocabulary([(r["term"], r["a"], r["b"]) for r in top], n, positive, size, chance, counted.count())
    names = counted.select("term").toArrow().column(0).combine_chunks()  # the terms of max_labelled texts at most
    picked = [i for i in pc.index_in(pa.array(chosen, pa.string()), names).to_pylist() if i is not None]
    size_of, shared = len(names), spark.sparkContext.broadcast(Terms(hashed(names)))
    del names

    def appearances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size_of, np.int64)
        for batch in batches:
            for part in _slices([batch]):
                for t, _ in shared.value.each(part.column(0).to_pylist()):
                    seen[t] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["t", "n"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x for part in _slices([batch]) for x in shared.value.each(part.column("__text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), batch.column("__hash"), *(pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1))], ["__id", "__label", "__hash", "t", "n"])

    df = np.zeros(size_of)
    seen_in = texts.select("__text").mapInArrow(appearances, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each of the names at most
    df[seen_in.column("t").to_numpy()] = seen_in.column("n").to_numpy()
    idf = np.log(1 + docs.count() / np.maximum(df, 1))
    idf[picked] *= stress
    del seen_in, df
    once = labelled.withColumn("__hash", F.xxhash64("__text")).dropDuplicates(["__id", "__hash"])
    rows = written(once.select("__id", "__label", "__hash", "__text").mapInArrow(extract, "__id long, __label int, __hash long, t array<int>, n array<int>"), "indexed")
    table = rows.select("__id", "__label", "t", "n").toArrow()
    lists = [[x.values.to_numpy() for x in table.column(c)] for c in ("t", "n")]  # max_labelled texts' terms
    index = spark.sparkContext.broadcast(Index.build(list(zip(table.column("__id").to_pylist(), [int(x > 0) for x in table.column("__label").to_pylist()], *lists, strict=True)), idf))
    del table, lists

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, (t, n) = batch.column("__id").to_pylist(), ([x.values.to_numpy() for x in batch.column(c)] for c in ("t", "n"))
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in index.value.votes(list(zip(t, n, ids, strict=True)), k)], pa.float64(), from_pandas=False), batch.column("__label")], ["raw", "__label"])

    tried = rows.repartition("__id", "__hash").mapInArrow(trial, "raw double, __label int").collect()
    lone, knots, values = calibration(np.array([r["raw"] for r in tried], float), np.array([r["__label"] > 0 for r in tried], float)) if tried else (0.0, np.array([0.0, 1.0]), np.array([0.0, 0.0]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in _slices(batches):
            texts = shared.value.each(batch.column("__text").to_pylist())
            keys = [hashlib.blake2b(np.concatenate(x).tobytes(), digest_size=16).digest() for x in texts]
            if len(known) > 50_000:
                known.clear()
            new = {key: (*x, None) for key, x in zip(keys, texts, strict=True) if key not in known}
            for key, (raw, at, s) in zip(new, index.value.votes(list(new.values()), k), strict=True):
                p = lone if np.isnan(raw) else float(np.interp(raw, knots, values))
                known[key] = (min(max(p, 0.0), 1.0), [int(x) for x in index.value.ids[at[:evidence]]], [float(x) for x in s[:evidence]])
            out = [known[key] for key in keys]
            kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], ["__id", "score", "evidence", "similarity"])

    scored = texts.mapInArrow(judge, "__id long, score double, evidence array<long>, similarity array<double>").withColumn(id_col, id_back("__id"))
    return scored.select(id_col, held(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")
