"""Removal of repeated byte strings with suffix arrays over shards of the strings that may repeat.

Winnowing picks, for every window of `length` bytes, the smallest hash of its inner k-grams; equal windows pick the same
one, so all places of a repeated string share a fingerprint. Places whose whole surroundings are equal are settled by
that equality; where surroundings differ, their bytes go to a shard, whose suffix array says which windows repeat. A
fingerprint of more bytes than a shard is first split by what all windows of a half of it hold around its k-gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Flags, by_group, discard, group_starts, id_back, long_id, mix, written
from tessera.llm.suffix_array import permuted_prefixes, suffix_array

GRAM = 24
CHUNK = 1 << 20  # bytes of a text that are fingerprinted at once
HELD = 100_000  # repeated places that a task remembers from batch to batch
PARTS = 4  # of a piece's windows, that are left out of the sorting if what they all hold is met once
_ROOTS = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


class _Powers:
    """Powers of the hashes' roots and of their inverses, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = (np.ones(1, np.uint64),) * 2

    def to(self, n: int) -> None:
        if len(self.up[0]) < n:
            powers = lambda r: np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 4096), r, np.uint64)])
            self.up = tuple(powers(r) for r in _ROOTS)
            self.down = tuple(powers(np.uint64(pow(int(r), -1, 2**64))) for r in _ROOTS)


_POWERS = _Powers()


def fingerprints(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(f, g1, g2, start, count, inner): for each picked k-gram the windows that pick it, start to start + count - 1, how far
    in it stands, its hash f, and 128 bits g of all the bytes those windows cover."""
    n, gram = len(b), min(GRAM, length)
    windows = n - length + 1
    _POWERS.to(n + 1)
    prefix = np.zeros((2, n + 1), np.uint64)
    for k in range(2):
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS.up[k][:n], out=prefix[k, 1:])
    h = mix((prefix[0, gram:] - prefix[0, :-gram]) * _POWERS.down[0][: n - gram + 1])
    width = length - gram + 1
    keyed = h & ~np.uint64(CHUNK * 2 - 1) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    low, span = keyed, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[:windows], low[width - span : width - span + windows])
    pick = (low & np.uint64(CHUNK * 2 - 1)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    count = np.diff(np.r_[start, windows])
    stop, inner = start + count - 1 + length, pick[start] - start
    shape = mix(inner.astype(np.uint64) << np.uint64(32) | count.astype(np.uint64))
    g1, g2 = (mix((prefix[k, stop] - prefix[k, start]) * _POWERS.down[k][start] ^ shape) for k in range(2))
    return h[pick[start]], g1, g2, start, count, inner


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.r_[0, flag.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


KEY = ["f", "g1", "g2", "id", "th", "start"]
PLACE = [*KEY, "count", "inner"]


def _columns(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _firsts(c: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of PLACE by KEY, and for each row: the first place of its surroundings, and whether it is a later one."""
    order = np.lexsort(tuple(c[k] for k in range(5, -1, -1)))
    c = [x[order] for x in c]
    again = np.r_[False, (c[0][1:] == c[0][:-1]) & (c[1][1:] == c[1][:-1]) & (c[2][1:] == c[2][:-1])]
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    itself = (c[3] == c[3][first]) & (c[4] == c[4][first]) & (c[5] == c[5][first])  # a repeated row is one document
    return c, again, again & ~itself


def _places(docs: DataFrame, length: int) -> DataFrame:
    """Fingerprinted places; later ones of equal surroundings within a task come as spans already (count 0, g1 their end).

    A task remembers the first places of surroundings that repeat in it, HELD of them at the most, so that of a passage
    that stands in very many texts each task sends one place on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def sent(c: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in c[:6]), *(pa.array(x.astype(np.int32)) for x in c[6:])], PLACE)

        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            for doc, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = np.frombuffer(raw.as_py(), np.uint8)
                for lo in range(0, max(len(b) - length + 1, 0), CHUNK):
                    part = b[lo : lo + CHUNK + length - 1]
                    if len(part) >= length:
                        f, g1, g2, start, count, inner = fingerprints(part, length)
                        rows.append((*(x.astype(np.int64) for x in (f, g1, g2)), np.full(len(f), doc), np.full(len(f), th), start + lo, count, inner))
            if not rows:
                continue
            marked = [(*r, np.zeros(len(r[0]), np.int64)) for r in rows]
            if held:
                marked.append((*held, np.ones(len(held[0]), np.int64)))
            c, again, span = _firsts(_columns(marked))
            yield sent([c[0][span], c[5][span] + c[6][span] - 1 + length, *(x[span] for x in c[2:6]), np.zeros(span.sum(), np.int64), c[7][span]])
            heads = np.flatnonzero(~again)
            often = (np.diff(np.r_[heads, len(again)]) > 1) | (np.maximum.reduceat(c[8], heads) > 0)
            if often.sum() > HELD:
                often[:] = False
            yield sent([x[heads[~often]] for x in c[:8]])
            held = [x[heads[often]] for x in c[:8]] if often.any() else None
        if held:
            yield sent(held)

    return docs.mapInArrow(run, "f long, g1 long, g2 long, id long, th long, start long, count int, inner int")


def _settled(places: DataFrame, length: int) -> DataFrame:
    """(kind, f, id, th, start, stop, inner): spans (0) and, of fingerprints with unlike surroundings, each kind's first place (1).

    Reads places by KEY as a stream and holds one row, so the size of a fingerprint's group is no matter to memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the current surroundings' first place, and whether it was sent
        sent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            f, g1, g2, doc, th, start, count, inner = (c.to_numpy() for c in batch.columns)
            done = count == 0
            out = [[np.zeros(done.sum(), np.int32), f[done], doc[done], th[done], start[done], g1[done], inner[done]]]
            f, g1, g2, doc, th, start, count, inner = (x[~done] for x in (f, g1, g2, doc, th, start, count, inner))
            stop = start + count - 1 + length
            if len(f):
                if last is not None:
                    f, g1, g2, doc, th, start, stop, inner = (np.r_[np.array([v], x.dtype), x] for v, x in zip(last, (f, g1, g2, doc, th, start, stop, inner), strict=True))
                new_f = np.r_[True, f[1:] != f[:-1]]
                new_g = new_f | np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]
                first = np.maximum.accumulate(np.where(new_g, np.arange(len(f)), 0))
                later = ~new_g & ~((doc == doc[first]) & (th == th[first]) & (start == start[first]))
                out.append([np.zeros(later.sum(), np.int32), f[later], doc[later], th[later], start[later], stop[later], inner[later]])
                heads = np.flatnonzero(new_g)
                like = np.r_[f[heads[1:]] == f[heads[:-1]], False]
                unlike = like | np.r_[False, like[:-1]]
                if last is not None and sent:
                    unlike[0] = False
                ask = heads[unlike]
                out.append([np.ones(len(ask), np.int32), f[ask], doc[ask], th[ask], start[ask], stop[ask], inner[ask]])
                k = heads[-1]
                sent = bool(unlike[-1]) or (sent and len(heads) == 1 and last is not None)
                last = (f[k], g1[k], g2[k], doc[k], th[k], start[k], stop[k], inner[k])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _columns(out)], ["kind", "f", "id", "th", "start", "stop", "inner"])

    return places.repartition("f").sortWithinPartitions(*KEY).mapInArrow(run, "kind int, f long, id long, th long, start long, stop long, inner int")


def _pieces(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of every asked place, as PIECE."""
    width = length - min(GRAM, length) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw")
            out = [(s["f"], i, t, s["start"], raw[s["start"] : s["stop"]], s["inner"], 0, width) for i, t, r, spots in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), raws, batch.column("spots").to_pylist(), strict=True) for raw in (r.as_py(),) for s in spots]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_KINDS, strict=True)], PIECE)

    spots = written(asked.groupBy("id", "th").agg(F.collect_list(F.struct("f", "start", "stop", "inner")).alias("spots")), "spots")  # at most a text's own places
    once = docs.where(Flags(spots.select("id", "th"), "id", "th").on()).dropDuplicates(["id", "th"])
    return once.join(spots, ["id", "th"]).select("id", "th", "raw", "spots").mapInArrow(cut, PIECE_SCHEMA)


#: hi - 1 >= how far a window's k-gram stands in it >= lo, for all windows of a piece
PIECE = ["f", "id", "th", "start", "piece", "inner", "lo", "hi"]
PIECE_KINDS = (*[pa.int64()] * 4, pa.binary(), *[pa.int32()] * 3)
PIECE_SCHEMA = "f long, id long, th long, start long, piece binary, inner int, lo int, hi int"


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces whose windows have the k-gram lo to hi - 1 bytes in, as up to two each, under fingerprints of their own: by halves of that range.

    All windows of a half hold the bytes from where the last of them begins to where the first ends, seen from the k-gram;
    equal windows have equal ones there, so those bytes are the new fingerprint.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, s, piece, inner, low, high in zip(*(batch.column(k).to_pylist() for k in PIECE[1:]), strict=True):
                for lo, hi in ((low, (low + high) // 2), ((low + high) // 2, high)):
                    first, last = max(inner - hi + 1, 0), min(inner - lo, len(piece) - length)  # a window x bytes into the piece has it inner - x bytes in
                    if first <= last:
                        shared = piece[inner - lo : inner - hi + 1 + length]
                        out.append((xxhash.xxh3_64_intdigest(shared, lo * (length + 1) + hi) - 2**63, i, t, s + first, piece[first : last + length], inner - first, lo, hi))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), PIECE_KINDS, strict=True)], PIECE)

    return pieces.select(*PIECE).mapInArrow(cut, PIECE_SCHEMA)


def _equal_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of pieces of one window each: later ones of equal bytes, met by a grouped minimum that is combined before it moves."""
    first = written(pieces.groupBy("f", "piece").agg(F.min(F.struct("id", "th", "start")).alias("m")), "first")
    later = pieces.join(first, ["f", "piece"]).where((F.col("id") != F.col("m.id")) | (F.col("th") != F.col("m.th")) | (F.col("start") != F.col("m.start")))
    return later.select("id", "th", "start", (F.col("start") + length).alias("stop"))


def _worth_sorting(pieces: list[tuple[int, bytes, int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(piece, where in it, bytes) of the runs of windows that may repeat, from (f, piece, inner, lo, hi).

    The windows of a part all hold the same bytes around the k-gram, and so would their equals in any other piece; where
    nobody else has those bytes, none of them repeats.
    """
    met: dict[int, int] = {}
    parts = []
    for k, (f, piece, inner, low, high) in enumerate(pieces):
        step = -(-(high - low) // PARTS)
        for hi in range(high, low, -step):  # in the order of the windows
            lo = max(hi - step, low)
            first, last = max(inner - hi + 1, 0), min(inner - lo, len(piece) - length)
            if first <= last:
                key = xxhash.xxh3_64_intdigest(piece[inner - lo : inner - hi + 1 + length], f + hi & 2**64 - 1)
                met[key] = met.get(key, 0) + 1
                parts.append((key, k, first, last))
    runs: list[list[int]] = []
    for key, k, first, last in parts:
        if met[key] > 1:
            if runs and runs[-1][0] == k and runs[-1][2] + 1 == first:
                runs[-1][2] = last
            else:
                runs.append([k, first, last])
    return np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int64), [pieces[k][1][first : last + length] for k, first, last in runs]


def _in_shards(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of a shard's windows that start earlier elsewhere in it, from its suffix array and common prefixes."""
    starts = [*group_starts(table, ["shard"]), table.num_rows]
    ids, ths, at = (table.column(k).to_numpy() for k in ("id", "th", "start"))
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        shard = table.slice(lo, hi - lo)
        of, inner, own = _worth_sorting(list(zip(*(shard.column(k).to_pylist() for k in ("f", "piece", "inner", "lo", "hi")), strict=True)), length)
        if not own:
            continue
        of += lo
        sizes = np.array([len(p) for p in own], np.int64)
        text = np.frombuffer(b"".join(p + b"\0" for p in own), np.uint8).astype(np.uint16) + np.uint16(1)
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 0
        order = suffix_array(text, 257)
        common = permuted_prefixes(text, order, stop=0)[order]
        piece = np.repeat(np.arange(len(own)), sizes + 1)
        begin = np.r_[0, ends[:-1] + 1]
        inside = np.arange(len(text)) - begin[piece]
        valid = inside + length <= sizes[piece]
        run = np.cumsum(common < length)  # suffixes of a run agree in their first `length` bytes
        some = valid[order]
        window, run = order[some], run[some]
        p = of[piece[window]]
        place = at[p] + inner[piece[window]] + inside[window]
        rank = np.lexsort((place, ths[p], ids[p], run))
        head = np.r_[True, run[rank][1:] != run[rank][:-1]]
        first = rank[np.maximum.accumulate(np.where(head, np.arange(len(rank)), 0))]
        a, b = p[rank], p[first]
        same = (ids[a] == ids[b]) & (ths[a] == ths[b]) & (place[rank] == place[first])
        flag = np.zeros(len(text), bool)
        flag[window[rank[~same]]] = True
        s, e = _runs(flag)
        k = of[piece[s]]
        base = at[k] + inner[piece[s]] - begin[piece[s]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ths[k]), pa.array(base + s), pa.array(base + e - 1 + length)], ["id", "th", "start", "stop"])


def repeated_spans(docs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(id, th, start, stop): spans that cover every repeated byte of docs (id, th, raw), perhaps overlapping."""
    settled = written(_settled(_places(docs, length), length), "settled")
    pieces = written(_pieces(settled.where("kind = 1").drop("kind"), docs, length), "pieces")
    spans = settled.where("kind = 0").select("id", "th", "start", "stop")
    while pieces is not None:  # a round halves what is left of large fingerprints: seven rounds at a length of 100
        sizes = written(pieces.groupBy("f").agg(F.sum(F.octet_length("piece")).alias("n"), F.count("*").alias("k")).where("k > 1"), "sizes")
        total = sizes.where(f"n <= {shard_bytes}").agg(F.sum("n")).first()[0] or 0
        shards = max(1, -(-total // shard_bytes))
        small = pieces.join(sizes.where(f"n <= {shard_bytes}").select("f"), "f").withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards)))
        spans = spans.unionByName(written(by_group(small, ["shard"], lambda t: _in_shards(t, length), "id long, th long, start long, stop long", 1), "repeats"))
        large = sizes.where(f"n > {shard_bytes}").select("f")
        halves = None
        if large.take(1):
            rest = written(pieces.join(large, "f"), "large")
            halves = written(_halved(rest.where("hi - lo > 1"), length), "halves")
            spans = spans.unionByName(written(_equal_windows(rest.where("hi - lo = 1"), length), "repeats"))
            discard(rest)
        discard(pieces, sizes)
        pieces = halves
    return spans


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = 1 << 20, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if with_text.

    Removed is every byte that a `length`-byte string covers which also starts earlier: in a smaller id, or before it
    in the same text. Matches stay within a text, and are judged on the input. A null text counts as empty; a null
    id is smaller than any other; texts that share an id are ordered by their hash, and rows of the same id and text
    are one document whose result each of them gets; texts shorter than length lose nothing; an empty table gives no
    rows; other columns are ignored. Whole surroundings (some 138 bytes) count as equal by 192 bits of hashes; all
    else is decided on the bytes.
    """
    raw = F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b""))
    rows = docs.select(long_id(id_col).alias("id"), raw.alias("raw")).select("id", F.xxhash64("raw").alias("th"), "raw")
    spans = repeated_spans(rows, length, shard_bytes)
    by_doc = written(spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")  # at most a text's own places
    touched = Flags(by_doc.select("id", "th"), "id", "th").on()
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = []
            for i, r, spans in zip(batch.column("id").to_pylist(), batch.column("raw"), lists, strict=True):
                raw = r.as_py()
                kept, at, n = [], 0, 0
                for lo, hi in sorted((s["start"], s["stop"]) for s in spans or []):
                    if lo > at or not n:
                        kept.append(raw[at:lo])
                        n += 1
                    at = max(at, hi)
                left = b"".join([*kept, raw[at:]])
                out.append((i, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left)[: 5 + with_text])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + with_text]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    clean = rows.where(~touched).select("id", "raw").mapInArrow(describe, schema)
    cut = rows.where(touched).join(by_doc, ["id", "th"], "left").select("id", "raw", "spans").mapInArrow(describe, schema)
    out = clean.unionByName(cut)
    return out.select(id_back("id").alias(id_col), *[c for c in out.columns if c != "id"])
