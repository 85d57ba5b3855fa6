"""Language identification: text, declared markup language, address suffix and host priors combined by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import long_id, written

BUCKETS = 1 << 14
#: What a match scans it takes, to the end where nothing closes it, and no tag reaches beyond the next "<": linear in any page.
_SKIP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>")
_LETTERS = re.compile(r"[\W\d_]+")
_LANG = re.compile(r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})")
_META = re.compile(r"(?is)<meta\b[^<>]*>")
_CONTENT = re.compile(r"(?is)\bcontent\s*=\s*[\"']?([A-Za-z]{2,8})")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def declared_in(page: str) -> str | None:
    """The language that a page's markup declares, by <html lang> or else by <meta content-language>."""
    if m := _LANG.search(page):
        return m[1]
    tags = (m[0] for m in _META.finditer(page))
    return next((c[1] for t in tags if "content-language" in t.lower() and (c := _CONTENT.search(t))), None)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters of a whole text, words apart."""
    raw = _LETTERS.sub(" ", text.lower()).strip()
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {raw} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    return (b[:-2] * 7919 + b[1:-1] * 131 * 17 + b[2:]) % BUCKETS


def fit(labelled: DataFrame, text_col: str, label_col: str, id_col: str, per_label: int = 1000) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) from about per_label labelled rows per language, those whose id's hash is in
    the first per_label / n of its range, or all n if they are fewer.

    Rows whose text or label is null are passed over. The labels are those present in the table, however many; each
    costs 64 KB where the model is held.
    """
    rows = labelled.select(F.col(text_col).alias("t"), F.lower(F.col(label_col)).alias("l"), F.xxhash64(id_col).alias("h")).where("t IS NOT NULL AND l IS NOT NULL")
    # A language of n rows keeps those whose hash is in the first per_label / n of its range: counts alone are needed for that.
    last = written(rows.groupBy("l").agg(F.ceil(F.lit(2.0**31) * F.least(F.lit(per_label) / F.count("*"), F.lit(1.0))).alias("last")), "last")
    labels = sorted(r["l"] for r in last.select("l").collect())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[label] = sums.get(label, 0) + np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for label, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(s[at])], ["l", "k", "n"])

    table = np.full((len(labels), BUCKETS), 0.5)
    some = rows.join(F.broadcast(last), "l").where("pmod(h, 2147483648) < last").select("t", "l")  # a row for each language
    got = some.mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    at = {label: i for i, label in enumerate(labels)}
    np.add.at(table, ([at[x] for x in got.column("l").to_pylist()], got.column("k").to_numpy()), got.column("n").to_numpy())
    return labels, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def evidence(rows: DataFrame, langs: list[str], model: np.ndarray, markup: bool, temper: float) -> DataFrame:
    """rows (id, body, declared, url, host) -> id, row hash, text log-likelihoods (tempered), letters, declared, suffix, host, domain."""
    shared = rows.sparkSession.sparkContext.broadcast(model.T.copy())  # BUCKETS x languages: 64 KB a language
    known = set(langs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, body, declared, url, host in zip(batch.column("rid").to_pylist(), batch.column("body"), *(batch.column(k).to_pylist() for k in ("declared", "url", "host")), strict=True):
                text = body.as_py() or ""
                if markup:
                    found = declared or declared_in(text)
                    text = html.unescape(_SKIP.sub(" ", text))
                else:
                    found = declared
                grams = trigrams(text)
                # Trigrams overlap and repeat, so their evidence counts for less than if each stood alone.
                ll = shared.value[grams].sum(0, dtype=np.float64) * temper if len(grams) else np.zeros(len(langs))
                m = _HOST.match(url or "")
                name = (m[1].lower().rstrip(".") if m else host) or ""
                labels = name.split(".")
                found = (found or "").lower().split("-")[0]
                out.append((row, ll - ll.max() if len(ll) else ll, len(grams), found if found in known else "?" if found else "", labels[-1] if m and len(labels) > 1 else "", name, ".".join(labels[-2:])))
            kinds = [pa.string(), pa.list_(pa.float64()), pa.int64(), *[pa.string()] * 4]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rid", "ll", "grams", "declared", "suffix", "host", "domain"])

    return rows.mapInArrow(read, "rid string, ll array<double>, grams long, declared string, suffix string, host string, domain string")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """Soft counts of each language by the columns, summed in parts before they are shuffled."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("soft")[i]) for i in range(size)]).alias(name))


def identify(
    docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str, body_col: str, declared_col: str | None = None, url_col: str | None = None,
    host_col: str | None = None, markup: bool = False, temper: float = 0.2, strength: float = 5.0, least: float = 0.5, carried: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, lang, posterior, text_lang, declared, suffix, host, rejected.

    The posterior multiplies the text's tempered likelihood, P(declared language | language), P(address suffix |
    language) and a host prior. The tables come from grouped sums of the text's own soft decisions over all rows; a
    host's prior shrinks to its domain's and that to all rows', each without the row itself, so a lone page does not
    vote twice. A row is rejected (lang null) if its body has no letters and nothing else raises a language to
    `least`, or if no language reaches it. Null bodies count as empty, null or unknown declarations, addresses and
    hosts as absent; a null id stays null; repeated rows are judged alike; an empty table gives no rows; other
    columns are ignored. Hot hosts are summed in parts and joined with a skew-split join. The string column `carried`,
    if given, comes last in the result: it tells rows apart that share an id.
    """
    none = F.lit(None).cast("string")
    rows = docs.select(
        (F.concat_ws(" ", long_id(id_col).cast("string"), F.col(carried)) if carried else long_id(id_col).cast("string")).alias("rid"), F.col(body_col).cast("string").alias("body"),
        (F.col(declared_col).cast("string") if declared_col else none).alias("declared"), (F.col(url_col) if url_col else none).alias("url"), (F.col(host_col) if host_col else none).alias("host"),
    )
    size = len(langs)
    if not size:
        return docs.limit(0).select(F.col(id_col), none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"), none.alias("host"), F.lit(True).alias("rejected"), *([F.col(carried)] if carried else []))
    seen = evidence(rows, langs, model, markup, temper).withColumn("soft", F.when(F.col("grams") > 0, _softmax(F.col("ll"))).otherwise(F.array(*[F.lit(1.0 / size)] * size)))
    seen = written(seen, "evidence")
    total = [float(x or 0.0) for x in seen.agg(*[F.sum(F.col("soft")[i]) for i in range(size)]).first()]
    count = sum(total) or 1.0
    overall = F.array(*[F.lit((t + 1.0) / (count + size)) for t in total])

    def conditional(column: str) -> DataFrame:
        """log P(value | language), one more for values never seen; absent values say nothing."""
        table = _sums(seen.where(F.col(column) != ""), [column], size, "c")
        sums = table.agg(*[F.sum(F.col("c")[i]) for i in range(size)], F.count("*")).first()
        values = (sums[size] or 0) + 1
        return written(table.select(column, F.array(*[F.log((F.col("c")[i] + 0.5) / F.lit(float(sums[i] or 0.0) + 0.5 * values)) for i in range(size)]).alias(f"{column}_ll")), column)

    host = written(_sums(seen.where("host <> ''"), ["host", "domain"], size, "host_c"), "host")
    domain = written(host.groupBy(F.col("domain").alias("domain")).agg(F.array(*[F.sum(F.col("host_c")[i]) for i in range(size)]).alias("domain_c")), "domain")
    prior = written(host.join(domain, "domain").select("host", "host_c", "domain_c"), "prior")
    zeros = F.array(*[F.lit(0.0)] * size)
    joined = seen.join(conditional("declared"), "declared", "left").join(conditional("suffix"), "suffix", "left").join(prior, "host", "left")
    less = lambda c: F.zip_with(F.coalesce(c, zeros), "soft", lambda x, y: F.greatest(F.when(F.col("host") != "", x - y).otherwise(x), F.lit(0.0)))
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    shrunk = lambda c, parent: F.zip_with(c, parent, lambda x, p: (x + F.lit(strength) * p) / (summed(c) + F.lit(strength)))
    joined = joined.withColumn("of_domain", less(F.col("domain_c"))).withColumn("of_host", less(F.col("host_c"))).withColumn("overall", overall)
    joined = joined.withColumn("up", shrunk(F.col("of_domain"), F.col("overall"))).withColumn("prior", shrunk(F.col("of_host"), F.col("up")))
    scores = F.array(*[F.log(F.col("prior")[i]) + F.col("ll")[i] + F.coalesce(F.col("declared_ll")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_ll")[i], F.lit(0.0)) for i in range(size)])
    joined = joined.withColumn("post", _softmax(scores)).withColumn("top", F.array_max("post"))
    names = F.array(*[F.lit(x) for x in langs])
    bad = (F.col("top") < least) | ((F.col("grams") == 0) & (F.col("declared").isin("", "?")))
    best = names[F.array_position("post", F.col("top")).cast("int") - 1]
    text = F.when(F.col("grams") > 0, names[F.array_position("soft", F.array_max("soft")).cast("int") - 1])
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    rid = F.substring_index("rid", " ", 1).cast("long")
    return joined.select(
        F.when(rid != -(2**63), rid).alias(id_col), F.when(~bad, best).alias("lang"), F.col("top").alias("posterior"), text.alias("text_lang"),
        blank("declared").alias("declared"), blank("suffix").alias("suffix"), blank("host").alias("host"), bad.alias("rejected"), *([F.expr("substring(rid, instr(rid, ' ') + 1)").alias(carried)] if carried else []),
    )
