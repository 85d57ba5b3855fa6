"""Mixing documents to target domain weights by soft membership and projected-gradient rates.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import id_back, long_id, written

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.88, "low": 0.07, "toxic": 0.05}
BINS = 8
_WORD = r"[\p{L}\p{N}_]+"


def label_domain() -> Column:
    """The domain of a row of labels: toxic, else high or low by quality; null where a needed label is null."""
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "high").when(F.col("quality") == 0, "low")


def _binned(x: Column, *edges: float) -> Column:
    """How many of the edges x reaches, 0 to BINS - 1."""
    return _let(x, lambda v: sum(((v >= F.lit(e)).cast("int") for e in edges), F.lit(0)))


def _let(value: Column, then) -> Column:
    """then(value), with value made once: inside a lambda it is a variable, not an expression to repeat."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _features(text: Column, words: Column, lists: list[list[str]]) -> Column:
    """array<int>: binned shape of a text, then whether it holds words that mark each domain."""
    n, w = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    few = (0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)
    shape = [
        _binned(F.length(text), 40, 150, 500, 1500, 4000, 12000, 40000), _binned(share(r"\p{Lu}"), *few), _binned(share(r"[^\p{L}\p{N}\s.,]"), *few), _binned(share("[0-9]"), *few),
        _binned(n / w, 3.0, 4.5, 5.5, 6.5, 8.0, 10.0, 14.0), _binned(F.size(F.array_distinct(words)) / w, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.97), _binned(share("\n"), *few),
    ]
    marks = [F.least(F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in some]).cast("array<string>"))), F.lit(BINS - 1)) for some in lists]
    return F.array(*shape, *marks)


class Mixer:
    """A classifier of domains and fitted rates, both as column expressions over a text."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, targets: dict[str, float], max_labelled: int, per_domain: int, temper: float, rounds: int, tolerance: float, carried: list[str]):
        self.text_col, self.domains = text_col, tuple(targets)
        self.temper = temper
        some = labelled.where("__domain IS NOT NULL AND __id IS NOT NULL").groupBy("__id").agg(F.max("__domain").alias("__domain"))
        some = written(some.orderBy(F.xxhash64("__id")).limit(max_labelled), "examples")  # bounded, so it is broadcast
        texts = docs.select(long_id(id_col).alias("__id"), self._text().alias("__text"), F.struct(*carried).alias("__doc")) if carried else docs.select(long_id(id_col).alias("__id"), self._text().alias("__text"))
        examples = texts.join(F.broadcast(some), "__id").select("__domain", "__text", F.regexp_extract_all(F.lower("__text"), F.lit(_WORD), F.lit(0)).alias("__words"))
        self.lists = self._marking_words(examples, per_domain)
        self.table = self._fit(examples)
        self.steps: list[tuple[list[float], float]] = []
        self.residual = np.zeros(len(self.domains))
        # What the result carries is written beside the posteriors, so no text is classified or moved again.
        kept = ["__doc"] if carried else []
        rows = texts.select("__id", F.xxhash64("__text").alias("__text_hash"), *kept, self._row(F.col("__text")).alias("x"))
        self.rows = written(rows.select("__id", "__text_hash", *kept, "x.tokens", "x.post"), "posteriors")
        self._descend(self.rows, targets, rounds, tolerance)

    def _text(self) -> Column:
        return F.coalesce(F.col(self.text_col), F.lit(""))

    def _marking_words(self, examples: DataFrame, per_domain: int) -> list[list[str]]:
        """For each domain the words that mark it most by log-likelihood ratio, at most per_domain."""
        sums = {r["__domain"]: r["count"] for r in examples.groupBy("__domain").count().collect()}
        n = sum(sums.values())
        counts = examples.select("__domain", F.explode(F.array_distinct("__words")).alias("w")).groupBy("w").agg(*[F.sum((F.col("__domain") == d).cast("int")).alias(d) for d in self.domains])
        counts = written(counts.where(" + ".join(f"`{d}`" for d in self.domains) + " >= 8"), "marking")
        least = 2 * math.log(max(counts.count(), 2) * 10)
        out = []
        for d in self.domains:
            share = sums.get(d, 0) / max(n, 1)
            if not 0 < share < 1:
                out.append([])
                continue
            a = F.col(d).cast("double")
            all_ = sum((F.col(x) for x in self.domains), F.lit(0)).cast("double")
            b = all_ - a
            part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
            g = 2 * (part(a, all_ * share) + part(b, all_ * (1 - share)))
            out.append([r["w"] for r in counts.where((a > all_ * share) & (g >= least)).orderBy(g.desc(), "w").limit(per_domain).collect()])
        return out

    def _fit(self, examples: DataFrame) -> np.ndarray:
        """log P(bin | domain) by feature, smoothed; the last plane holds the log priors."""
        size = len(self.lists) + 7
        table = np.ones((size, BINS, len(self.domains)))
        prior = np.ones(len(self.domains))
        binned = examples.select("__domain", F.posexplode(_features(F.col("__text"), F.col("__words"), self.lists)).alias("f", "b"))
        for r in binned.groupBy("__domain", "f", "b").count().collect():  # domains x features x bins at most
            at = self.domains.index(r["__domain"])
            table[r["f"], r["b"], at] += r["count"]
            prior[at] += r["count"] / size
        table = np.log(table / table.sum(1, keepdims=True))
        return np.concatenate([table, np.broadcast_to(np.log(prior / prior.sum()), (1, BINS, len(self.domains)))])

    def _row(self, text: Column) -> Column:
        """struct<tokens, post> of a text; words and features are made once."""
        words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
        return _let(words, lambda w: F.struct(F.size(w).cast("double").alias("tokens"), _let(_features(text, w, self.lists), self._posterior).alias("post")))

    def _posterior(self, features: Column) -> Column:
        places = F.zip_with(features, F.sequence(F.lit(0), F.size(features) - 1), lambda b, f: f * BINS + b + 1)
        flat = [F.array(*[F.lit(float(x)) for x in self.table[:-1, :, k].ravel()]) for k in range(len(self.domains))]
        scores = lambda at: F.array(*[F.lit(float(self.table[-1, 0, k])) + F.lit(self.temper) * F.aggregate(at, F.lit(0.0), self._add(flat[k])) for k in range(len(self.domains))])
        raised = lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
        share = lambda x: _let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(x, lambda v: v / total))
        return _let(_let(_let(places, scores), raised), share)

    @staticmethod
    def _add(logs: Column):
        return lambda acc, at: acc + F.element_at(logs, at)

    def rates(self, post: Column) -> Column:
        """struct<r, y>: the document's rate after all steps so far, and the point the next gradient is taken at.

        Each step was r' = max(0, y - posterior . whitened residual), with Nesterov's momentum; documents start at 1.
        """
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        if not self.steps:
            return start
        steps = F.expr("array(" + ", ".join(f"named_struct('g', array({', '.join(f'{x!r}D' for x in g)}), 'm', {m!r}D)" for g, m in self.steps) + ")")

        def step(acc: Column, x: Column) -> Column:
            slope = F.aggregate(F.zip_with(post, x["g"], lambda p, g: p * g), F.lit(0.0), lambda a, v: a + v)
            r = F.greatest(acc["y"] - slope, F.lit(0.0))
            return F.struct(r.alias("r"), (r + x["m"] * (r - acc["r"])).alias("y"))

        return F.aggregate(steps, start, step)

    def _descend(self, rows: DataFrame, targets: dict[str, float], rounds: int, tolerance: float) -> None:
        """Projected gradient on |sum of rate x tokens x posterior - targets|^2, whitened; only sums by domain reach the driver."""
        size = len(self.domains)
        pairs = [F.sum(F.col("tokens") * F.col("post")[i] * F.col("post")[j]) for i in range(size) for j in range(size)]
        first = rows.agg(F.sum("tokens"), *pairs).first()
        total = float(first[0] or 0)
        if not total:
            return
        curve = np.array([float(x) for x in first[1:]]).reshape(size, size) / total
        # Domains overlap and differ in size; in whitened coordinates the curvature is 1, and so is the step.
        whiten = np.linalg.pinv(curve, rcond=1e-9)
        goal = np.array([targets[d] for d in self.domains]) / sum(targets.values())
        t, far = 1.0, []
        for _ in range(rounds):
            state = rows.select("tokens", "post", self.rates(F.col("post")).alias("s"))
            sums = state.agg(*[F.sum(F.col("tokens") * F.col("post")[i] * F.col(f"s.{v}")) for v in "ry" for i in range(size)]).first()
            at_r, at_y = (np.array([float(x) for x in half]) / total for half in (sums[:size], sums[size:]))
            self.residual = at_r - goal
            far.append(float(np.abs(self.residual).max()))
            if far[-1] <= tolerance or len(far) > 8 and min(far[-4:]) > 0.98 * min(far[:-4]):  # reached, or out of reach
                return
            after = (1 + math.sqrt(1 + 4 * t * t)) / 2
            self.steps.append(([float(x) for x in whiten @ (at_y - goal)], (t - 1) / after))
            t = after

    def rated(self) -> DataFrame:
        """rows with rate and copies: the rate rounded up or down by a hash of the id and text."""
        rows = self.rows.withColumn("rate", self.rates(F.col("post"))["r"])
        return rows.withColumn("copies", F.floor(F.col("rate") + _chance(F.col("__id"), F.col("__text_hash"))).cast("int"))


def _chance(id_: Column, text_hash: Column) -> Column:
    """A number in [0, 1) that is the same for the same id and text in every run."""
    return F.pmod(F.xxhash64(F.lit("mixing"), id_, text_hash), F.lit(1 << 20)) / F.lit(float(1 << 20))


def mixer(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, max_labelled: int = 20_000,
    per_domain: int = 64, temper: float = 0.6, rounds: int = 30, tolerance: float = 1e-4, carried: list[str] | None = None,
) -> Mixer:
    """Fits domain posteriors on at most max_labelled labelled rows and rates on all of docs; rows keep the columns `carried`.

    The token budget is docs' own number of words; targets are shares of it. Null texts count as empty and have no
    tokens, null ids have no label; repeated rows count as often as they come; with no labels all domains are equally
    likely everywhere; an empty table keeps every rate at 1. A domain that no document can belong to is missed by as
    much as it must be; steps end when they no longer help, or after `rounds`.
    """
    labelled = labels.select(F.col(id_col).cast("long").alias("__id"), label_domain().alias("__domain"))
    return Mixer(docs, labelled, id_col, text_col, targets or TARGETS, max_labelled, per_domain, temper, rounds, tolerance, carried or [])


def document_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: id, n_tokens, p_<domain>..., rate, copies. Edge cases as for mixer; other columns are ignored."""
    fitted = mixer(docs.select(id_col, text_col), labels, id_col, text_col, **how)
    rows = fitted.rated()
    return rows.select(id_back("__id").alias(id_col), F.col("tokens").cast("long").alias("n_tokens"), *[F.col("post")[k].alias(f"p_{d}") for k, d in enumerate(fitted.domains)], "rate", "copies")


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with each row as often as its rate says (rounded by hash), all columns as they were. Edge cases as for mixer."""
    rows = mixer(docs, labels, id_col, text_col, carried=docs.columns, **how).rated().where("copies > 0")
    return rows.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__doc.*")
