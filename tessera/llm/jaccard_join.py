"""Set-similarity self-join on word n-grams by chosen paths (recursive splits on sampled shared tokens)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import NULL_ID, Flags, by_group, discard, group_starts, id_back, local_components, long_id, mix, written
from tessera.llm.shingles import Shingler, set_key
from tessera.llm.tiles import tiled

WIDTH = 64  # min-hash coordinates that embed a set
_SEEDS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def least_common(recall: float, threshold: float, slack: float) -> int:
    """Coordinates that two sketches must share to be likely: slack below the threshold, or fewer if a pair at the threshold would fall short too often."""
    least = int(np.floor((threshold - slack) * WIDTH))
    while least > 0 and sum(_binomial(WIDTH, m, threshold) for m in range(least)) > (1 - recall) / 2:
        least -= 1
    return least


def _binomial(n: int, k: int, p: float) -> float:
    return comb(n, k) * p**k * (1 - p) ** (n - k)


def missed(roots: int, threshold: float, depth: int, least: int) -> float:
    """The probability that a pair at the threshold meets in no leaf, if every bucket on its way is a large one.

    Of the m coordinates that the pair shares, k are roots. A path goes on from a split through each coordinate that it
    samples, with probability 1 / (threshold * WIDTH), and is compared there and then if it samples none; so it meets
    in `deeper` of all cases. Fewer than `least` shared coordinates count as a miss.
    """
    chance, out = 1 / (threshold * WIDTH), 0.0
    for m in range(WIDTH + 1):
        deeper = 1.0
        for _ in range(depth):
            deeper = min(1.0, 1 - (1 - chance * deeper) ** m + (1 - chance) ** WIDTH)
        of_roots = (comb(m, k) * comb(WIDTH - m, roots - k) / comb(WIDTH, roots) * (1 - deeper) ** k for k in range(roots + 1))
        out += _binomial(WIDTH, m, threshold) * (1.0 if m < least else sum(of_roots))
    return out


def roots_for(recall: float, threshold: float, depth: int, least: int) -> int:
    """Root coordinates, a run each and no coordinate twice, after which a pair at the threshold meets with probability recall at the least."""
    return next((r for r in range(1, WIDTH) if missed(r, threshold, depth, least) <= 1 - recall), WIDTH)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, roots: int) -> DataFrame:
    """(id, n shingles, k1, k2, sketch, paths): what stands for a document's set everywhere but in the final check."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            mins = np.zeros((len(sets), WIDTH), np.uint64)
            if len(some):
                flat = np.concatenate([sets[k] for k in some])
                at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                for c in range(WIDTH):
                    x = (flat ^ _SEEDS[c]) * np.uint64(0x9FB21C651E98DF25)
                    mins[some, c] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
            keys = [set_key(s) for s in sets]
            paths = np.stack([mix(mins[:, c] + np.uint64(c * 4097)) for c in range(roots)], 1)
            low = mix(mins).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([row.tobytes() for row in low], pa.binary()), pa.array(list(paths.astype(np.int64)), pa.list_(pa.int64())),
                ],
                ["id", "text_hash", "size", "k1", "k2", "sketch", "paths"],
            )

    rows = docs.select(long_id(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, "id long, text_hash long, size long, k1 long, k2 long, sketch binary, paths array<long>")


def _likely(table: pa.Table, keys: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) that connect the rows of each group whose sketches agree in `least` coordinates: a spanning forest."""
    group = np.zeros(table.num_rows, np.int64)
    group[group_starts(table, keys)] = 1
    group = np.cumsum(group)
    ids = table.column("cid").to_numpy()
    s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, WIDTH)
    a, b, step = [], [], 1
    at = np.arange(len(ids))
    while True:
        at = at[at + step < len(ids)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        for lo in range(0, len(at), 65536):
            i = at[lo : lo + 65536]
            near = i[(s[i] == s[i + step]).sum(1) >= least]
            a.append(near)
            b.append(near + step)
        step += 1
    if a:
        root = local_components(len(ids), np.concatenate(a), np.concatenate(b))
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["src", "dst"])


def candidates(classes: DataFrame, threshold: float, leaf: int, depth: int, least: int, used: list[DataFrame] | None = None) -> DataFrame:
    """Edges between classes that are likely similar, found at the leaves of the chosen paths; the written tables that hold them go to `used`.

    A bucket of at most `leaf` sets is compared outright. A larger one is split again on the coordinates its path
    samples; one whose path samples none, or that is still larger after `depth` splits, is compared in tiles of two
    blocks of 16 * leaf sets. Beyond the first buckets only the sketches of sets in larger ones are kept, so what a
    split moves follows the rows it splits and not all sets.
    """
    spread = classes.select("cid", F.explode("paths").alias("path"))
    sketch = classes.select("cid", "sketch")
    edges: list[DataFrame] = []
    done: list[DataFrame] = []
    chance = np.uint64(2**64 / (threshold * WIDTH))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy().astype(np.uint64)
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, WIDTH)
            ids = batch.column("cid").to_numpy()
            ended = np.ones(len(ids), bool)
            for c in range(WIDTH):  # the path alone decides, so all sets of a bucket sample alike
                on = np.flatnonzero(mix(path + np.uint64(0x51ED270B * (c + 1))) < chance)
                if len(on):
                    ended[on] = False
                    down = mix(mix(path[on]) ^ (s[on, c].astype(np.uint64) << np.uint64(8) | np.uint64(c)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(down.astype(np.int64)), pa.array(np.zeros(len(on), bool))], ["cid", "path", "ended"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[ended]), batch.column("path").filter(pa.array(ended)), pa.array(ended[ended])], ["cid", "path", "ended"])

    for level in range(depth + 1):
        sizes = written(spread.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        shared = written(spread.join(sizes, "path").select("cid", "path", "n"), "shared")  # few rows: most buckets hold one set
        small = shared.where(F.col("n") <= leaf).select("cid", "path").join(sketch, "cid")
        edges.append(written(by_group(small, ["path"], lambda t: _likely(t, ["path"], least), "src long, dst long").distinct(), "likely"))
        large = shared.where(F.col("n") > leaf).select("cid", "path")
        done += [sizes, shared]
        if not large.take(1):
            break
        sketch = written(sketch.where(Flags(large, "cid").on()), "kept")  # a sketch flagged in vain meets nothing
        done.append(sketch)
        ended = large
        if level < depth:
            moved = written(large.join(sketch, "cid").mapInArrow(split, "cid long, path long, ended boolean"), "split")
            done.append(moved)
            spread, ended = moved.where("NOT ended").drop("ended"), moved.where("ended").drop("ended")
        if ended.take(1):
            # Only sketches meet here, so blocks are larger than a leaf and each row is copied to fewer tiles.
            tiles = tiled(ended, ["path"], "cid", 16 * leaf).select("cid", "path", "t1", "t2").join(sketch, "cid")
            edges.append(written(by_group(tiles, ["path", "t1", "t2"], lambda t: _likely(t, ["path", "t1", "t2"], least), "src long, dst long", 2048).distinct(), "likely"))
    discard(*done)
    if used is not None:
        used += edges
    return reduce(DataFrame.unionByName, edges)


def _partners(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """The rows (cid, comp, t1, t2, b) of each tile whose sketch agrees in `least` coordinates with another's there."""
    s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, WIDTH)
    b, t1, t2 = (table.column(k).to_numpy() for k in ("b", "t1", "t2"))
    keep = np.zeros(table.num_rows, bool)
    starts = [*group_starts(table, ["comp", "t1", "t2"]), table.num_rows]
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        own = s[lo:hi]
        for k in range(hi - lo - 1):
            near = (own[k + 1 :] == own[k]).sum(1) >= least
            if t1[lo] != t2[lo]:
                near &= b[lo + k + 1 : hi] != b[lo + k]
            if near.any():
                keep[lo + k] = True
                keep[lo + k + 1 : hi] |= near
    yield from table.select(["cid", "comp", "t1", "t2", "b"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _exact(table: pa.Table, shingle: Shingler, times: int, over: int) -> Iterator[pa.RecordBatch]:
    """Exact comparison of the whole sets in each tile: links per class, and edges that span its linked classes."""
    starts = [*group_starts(table, ["comp", "t1", "t2"]), table.num_rows]
    t1, t2, b = (table.column(k).to_numpy() for k in ("t1", "t2", "b"))
    cids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
    keys = np.stack([table.column("k1").to_numpy(), table.column("k2").to_numpy()], 1)
    texts = table.column("text")
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        sets, at = [], []
        seen: set[int] = set()
        for k in range(lo, hi):  # a repeated id may bring another text, or a text twice
            s = shingle(texts[k].as_py())
            if int(cids[k]) not in seen and set_key(s) == tuple(keys[k]):
                seen.add(int(cids[k]))
                sets.append(s)
                at.append(k)
        at = np.array(at, np.int64)
        if len(at) < 2:
            continue
        sizes = np.array([len(s) for s in sets], np.int64)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[col] > 1
        row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        width = 4096
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            on = slice(*np.searchsorted(col, [c, c + width]))
            m = np.zeros((len(sets), width), np.float32)
            m[row[on], col[on] - c] = 1
            common += m @ m.T
        both = common.astype(np.int64)
        near = over * both >= times * (sizes[:, None] + sizes[None, :] - both)
        if t1[lo] != t2[lo]:
            near &= b[at][:, None] != b[at][None, :]
        i, j = np.nonzero(np.triu(near, 1))
        if not len(i):
            continue
        found = np.zeros(len(sets), np.int64)
        np.add.at(found, i, copies[at[j]])
        np.add.at(found, j, copies[at[i]])
        root = local_components(len(sets), i, j)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cids[at[some]]), pa.array(cids[at[root[some]]]), pa.array(found[some])], ["cid", "other", "n"])


def similarity_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (4, 5),
    recall: float = 0.9999, leaf: int = 128, depth: int = 4, slack: float = 0.2, block: int = 256, with_hash: bool = False,
) -> DataFrame:
    """One row per row of docs: id, class_id, n_links, kept.

    Two documents link when the Jaccard similarity of their sets of n-word shingles is at least similarity (a fraction,
    four fifths). class_id is the smallest id reachable by links, n_links the number of other documents linked
    directly, kept whether the id is its class's. Null and wordless texts link with nothing; a text of fewer than n
    words is one shingle; a null id is an id of its own, smallest of all; repeated rows count as documents each and
    share their class; an empty table gives no rows; other columns are ignored, whatever their names.

    Equal sets are one class. Chosen paths over min-hash coordinates find likely links with the given recall for a
    pair at the threshold. Classes that they connect meet in tiles: first their sketches, which a pair at the threshold
    passes but for 1e-9, then the whole sets of those with a partner, so that no pair is ever written out.
    """
    times, over = similarity
    threshold = times / over
    least = least_common(recall, threshold, slack)
    sig = written(sketches(docs, id_col, text_col, n, roots_for(recall, threshold, depth, least)), "sketches")
    sets = sig.where("size > 0")
    cid = F.xxhash64("k1", "k2", "size").alias("cid")
    classes = sets.groupBy("k1", "k2", "size").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"), F.any_value("paths").alias("paths"))
    classes = written(classes.select(cid, "k1", "k2", "rep", "copies", "sketch", "paths"), "sets")
    edges: list[DataFrame] = []
    likely = connected_components(candidates(classes, threshold, leaf, depth, least, edges))
    discard(*edges)
    members = classes.where(Flags(likely.select(F.col("node").alias("cid")), "cid").on()).select("cid", "k1", "k2", "rep", "copies", "sketch")
    near = written(members.join(likely.withColumnRenamed("node", "cid").withColumnRenamed("component", "comp"), "cid"), "near")
    # Sketches meet first; a text goes only to the tiles that hold a likely partner of it.
    sure = least_common(1 - 1e-9, threshold, 0.0)
    tiles = tiled(near.select("cid", "comp", "sketch"), ["comp"], "cid", block)
    meet = written(by_group(tiles, ["comp", "t1", "t2"], lambda t: _partners(t, sure), "cid long, comp long, t1 int, t2 int, b int"), "meet")
    wanted = written(near.select("cid", "k1", "k2", "rep", "copies").join(meet, "cid"), "wanted")
    discard(near, meet)
    texts = docs.select(long_id(id_col).alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tiles = wanted.join(texts.where(Flags(wanted.select("rep").distinct(), "rep").on()), "rep")

    def check(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        return _exact(batch, Shingler(n), times, over)

    found = written(by_group(tiles, ["comp", "t1", "t2"], check, "cid long, other long, n long", 1024), "links")
    discard(wanted)
    linked = connected_components(found.select(F.col("cid").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "cid")
    group = classes.select("cid", "rep", "copies").join(linked, "cid", "left").select("cid", "rep", "copies", F.coalesce("component", "cid").alias("component"))
    group = written(group.join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left"), "groups")
    low = written(group.groupBy("component").agg(F.min("rep").alias("class_id")), "lowest")
    result = written(group.join(low, "component").select("cid", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "classes")
    discard(classes, found, group, low)
    out = sig.select("id", "text_hash", F.when(F.col("size") > 0, F.xxhash64("k1", "k2", "size")).alias("cid")).join(result, "cid", "left")
    out = out.select("id", "text_hash", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(id_back("id").alias(id_col), id_back("class_id").alias("class_id"), "n_links", (F.col("id") == F.col("class_id")).alias("kept"), *(["text_hash"] if with_hash else []))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay when of each class of similarity_join one document is kept: that of the smallest id.

    Wordless and null texts all stay, but a repeated row (same id, same text) stays once.
    """
    judged = similarity_join(docs, id_col, text_col, with_hash=True, **how)
    judged = written(judged.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("__id"), F.col("text_hash").alias("__text"), "kept"), "judged")
    key = ["__id", "__text"]
    drop = written(judged.where("NOT kept").select(*key).distinct(), "drop")
    keyed = docs.withColumns({"__id": long_id(id_col), "__text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    in_drop = Flags(drop, *key).on()
    left = keyed.where(~in_drop).unionByName(keyed.where(in_drop).join(drop, key, "left_anti"))
    again = written(judged.groupBy(*key).agg(F.count("*").alias("__times")).where("__times > 1").select(*key), "again")
    discard(judged)
    if again.take(1):  # equal rows: one stays
        repeated = Flags(again, *key).on()
        maybe = left.where(repeated)
        once = maybe.join(again, key, "left_semi").dropDuplicates(key)
        left = left.where(~repeated).unionByName(maybe.join(again, key, "left_anti")).unionByName(once)
    return left.select(*docs.columns)
