"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Only lengths below the capacity need packing, and there are at most capacity - 1 of them, so the whole problem is a
histogram of bounded size whatever the corpus. The driver completes bins on that histogram; executors then hand the
slots out by each piece's rank among the pieces of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import id_back, long_id, written

PIECES = "__id long, __row long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whole texts, remembered by word.

    The byte-level tokenizer never joins a run of white space with what stands before it, so a text's ids are those of
    its words, each taken with the white space before it. Where the ranks of the same vocabulary lie beside the JSON
    file they encode the words that are not remembered, else the JSON's own tokenizer does.
    """

    KEEP = 32 << 20  # characters of remembered words; a word of more than LONG is not remembered
    LONG = 256

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = re.compile(r"\s*\S+|\s+").findall
        self.known: dict[str, bytes] = {}
        self.held = 0
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import base64

            import public_tokenizers
            import tiktoken

            with ranks.open("rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            self.encode = lambda word: self.whole.encode(word, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, words = self.known, self.words(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self._learn(w) for w in words])

    def _learn(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= self.LONG:
            if self.held > self.KEEP:
                self.known.clear()
                self.held = 0
            self.known[word] = ids
            self.held += len(word) + 64
        return ids


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: every document's ids and end_id, cut from the end into capacity-long pieces when longer."""
    import zlib

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, row = WordIds(tokenizer), np.uint32(end_id).tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids_of(text.as_py()) + end
                n, row = len(data) // 4, row + 1
                at = n % capacity or min(capacity, n)
                for k, (lo, hi) in enumerate(zip([0, *range(at, n, capacity)], [*range(at, n, capacity), n], strict=True)):
                    out.append((doc, row, k, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi])))
            names = ["__id", "__row", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)

    return docs.select(long_id(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without (volume, and Martello and Toth's bound over every threshold)."""
    n, mass = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    half, top = capacity // 2, len(counts) - 1
    a = np.arange(1, half + 1)
    upto = np.minimum(capacity - a, top)
    large, middle = n[top] - n[upto], n[upto] - n[min(half, top)]
    free = middle * capacity - (mass[upto] - mass[min(half, top)])
    small = mass[min(half, top)] - mass[a - 1]
    return int(max(-(-mass[top] // capacity), (large + middle + np.maximum(0, -(-(small - free) // capacity))).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: (lengths of a filling, how often), the first incumbent."""
    left = counts.copy()
    by_room: dict[int, list[list]] = {}
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        if not n:
            continue
        # Tightest room first; a group of equal bins is split when only some of them are used.
        fits = sorted(r for r in by_room if r >= length and by_room[r])
        for room in fits:
            groups, by_room[room] = by_room[room], []
            for k, (filling, times) in enumerate(groups):
                if not n:
                    by_room[room].extend(groups[k:])
                    break
                each = min(room // length, n)
                used = min(times, n // each)
                if used:
                    by_room.setdefault(room - each * length, []).append((filling + (length,) * each, used))
                    n -= used * each
                rest = times - used
                if rest and n and n < each:
                    by_room.setdefault(room - n * length, []).append((filling + (length,) * n, 1))
                    n, rest = 0, rest - 1
                if rest:
                    by_room[room].append((filling, rest))
            if not n:
                break
        if n:
            each = capacity // length
            if n // each:
                by_room.setdefault(capacity - each * length, []).append(((length,) * each, n // each))
            if n % each:
                by_room.setdefault(capacity - (n % each) * length, []).append(((length,) * (n % each), 1))
    return [x for room in sorted(by_room) for x in by_room[room]]


def _sums(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """For each k the set of sums up to room that the first k lengths make, each at most as often as it is there, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for x, n in zip(lengths, counts, strict=True):
        bits, n, step = out[-1], min(n, room // x), 1
        while n > 0:
            take = min(step, n)
            bits |= bits << (take * x) & mask
            n, step = n - take, step * 2
        out.append(bits)
    return out


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's members surely fit into a's, some into each: then a takes what is harder to place."""
    room = sorted(a)
    for x in b:
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            return False
        room[k] -= x
        room.sort()
    return True


def completions(left: np.ndarray, largest: int, capacity: int, spare: int, width: int) -> list[tuple[int, ...]]:
    """The width undominated fillings around the largest length that waste least, wasting at most spare, larger members first.

    Which sums the lengths can make is known before any filling is built, so the walk meets no dead end; it goes from the
    fullest sum down, and a filling whose members fit into those of one already found is passed over. At most 8 * width
    fillings are looked at.
    """
    room = capacity - largest
    own = left[: room + 1].copy()
    if largest <= room:
        own[largest] -= 1
    have = [int(x) for x in np.flatnonzero(own > 0) if x]
    counts = [int(own[x]) for x in have]
    sums = _sums(have, counts, room)
    found: list[tuple[int, ...]] = []

    def grow(k: int, rest: int, chosen: tuple[int, ...], tries: list[int]) -> None:
        if not rest:
            if not any(_dominates(f[1:], chosen) for f in found):
                found.append((largest, *chosen))
            tries[0] -= 1
            return
        for at in range(k, 0, -1):
            x = have[at - 1]
            if not sums[at] >> rest & 1:  # nor do fewer lengths make it
                return
            for n in range(min(counts[at - 1], rest // x), 0, -1):
                if sums[at - 1] >> (rest - n * x) & 1:
                    grow(at - 1, rest - n * x, chosen + (x,) * n, tries)
                    if len(found) >= width or tries[0] <= 0:
                        return

    tries = [8 * width]  # fillings looked at, dominated ones among them
    for total in range(room, max(room - spare, 0) - 1, -1):
        if sums[-1] >> total & 1:
            grow(len(have), total, (), tries)
            if len(found) >= width or tries[0] <= 0 or len(found) and len(found[-1]) <= 2:  # one other member, or none: it dominates all that fill less
                break
    return found


def complete(counts: np.ndarray, capacity: int, nodes: int = 3000, width: int = 6, told: dict | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion branch-and-bound on the histogram; the best fillings found, surely fewest where they meet the lower bound.

    The best-fit packing is the first incumbent. Each node takes the largest length left, tries its undominated fillings
    by their waste, each as often as the counts allow, and is cut when its waste exceeds what a packing of one sequence
    less may waste, when its lengths' own bound rules that out, or when the same lengths were left with no more
    sequences before. nodes bounds the search; what is left open then keeps the incumbent, which is always complete.
    told, if given, gets the best-fit and final sequences, the lower bound and the nodes used.
    """
    incumbent = best_fit(counts, capacity)
    first = best = sum(t for _, t in incumbent)
    bound, used = lower_bound(counts, capacity), 0
    total = int((counts * np.arange(len(counts))).sum())
    stack: list[tuple[np.ndarray, tuple | None, int, int]] = [(counts.copy(), None, 0, 0)]
    seen: dict[bytes, int] = {}
    while stack and best > bound and used < nodes:
        left, made, n, waste = stack.pop()
        if not left.any():
            if n < best:
                incumbent, best = _unrolled(made), n
            continue
        spare = (best - 1) * capacity - total - waste
        if spare < 0 or n + lower_bound(left, capacity) >= best or seen.get(key := hashlib.blake2b(left.tobytes(), digest_size=16).digest(), best) <= n:
            continue
        seen[key] = n
        used += 1
        largest = int(np.flatnonzero(left)[-1])
        for filling in reversed(completions(left, largest, capacity, spare, width)):
            uses = np.bincount(filling, minlength=len(left))
            some = uses > 0
            lost = capacity - sum(filling)
            times = int((left[some] // uses[some]).min())
            times = max(1, min(times, spare // lost if lost else times))
            stack.append((left - uses * times, (made, filling, times), n + times, waste + lost * times))
    if told is not None:
        told.update(best_fit=first, sequences=best, bound=bound, nodes=used)
    return incumbent


def _unrolled(made: tuple | None) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while made is not None:
        made, filling, times = made
        out.append((filling, times))
    return out[::-1]


def slots(fillings: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For every length, runs of ranks: first rank, first sequence, offset; sequences count up with the ranks."""
    rows, taken, sequence = [], np.zeros(size, np.int64), 0
    for filling, times in fillings:
        at = 0
        for length in filling:
            rows.append((length, int(taken[length]), sequence, at))
            taken[length] += times
            at += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 48 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, chunk: int = 100_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and give the end id alone; a null id stays null; repeated rows are packed as often as
    they come; an empty table gives no rows; other columns are ignored, whatever their names. Full pieces have a
    sequence of their own. Ranks within a length are counted in chunks of about `chunk` rows, so that a length that
    most pieces share is still ranked by many tasks; only counts by length and chunk reach the driver's plan.
    """
    spark = docs.sparkSession
    # A piece's place is its rank by (id, row) within its length: stable however tasks are retried.
    rows = written(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    total = rows.count()
    parts = max(1, -(-total // chunk))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__id", "__row", "piece"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    by_length = sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        counts[r["length"]] = r["n"]
    full, counts[capacity] = int(counts[capacity]), 0
    fillings = complete(counts, capacity)
    if full:
        fillings = [*fillings, ((capacity,), full)]
    plan = spark.sparkContext.broadcast(slots(fillings, capacity + 1))  # a run per length of a filling: bounded by the fillings, not the corpus

    before = written(sizes.selectExpr("length", "__part", "sum(__n) OVER (PARTITION BY length ORDER BY __part) - __n AS __before"), "ranks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at, last = plan.value, 0, None
        for batch in batches:
            length, part, before = (batch.column(k).to_numpy() for k in ("length", "__part", "__before"))
            if not len(length):
                continue
            new = np.ones(len(length), bool)
            new[1:] = (length[1:] != length[:-1]) | (part[1:] != part[:-1])
            new[0] = (int(length[0]), int(part[0])) != last
            starts = np.where(new, np.arange(len(new)), 0)
            within = np.arange(len(new)) - np.maximum.accumulate(starts)
            first = int(np.argmax(new)) if new.any() else len(new)
            within[:first] += at
            rank = before + within
            at, last = int(within[-1]) + 1, (int(length[-1]), int(part[-1]))
            run = np.searchsorted(p["key"], length << np.int64(48) | rank, "right") - 1
            where = {"sequence_id": pa.array(p["sequence"][run] + rank - p["rank"][run]), "offset": pa.array(p["offset"][run])}
            names = ["__id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *where.values()], [*names, *where])

    placed = rows.join(before, ["length", "__part"]).select("__id", "__row", "piece", "start", "length", "ids_crc32", "__part", "__before")
    placed = placed.repartition("length", "__part").sortWithinPartitions("length", "__part", "__id", "__row", "piece").mapInArrow(place, "__id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(id_back("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
