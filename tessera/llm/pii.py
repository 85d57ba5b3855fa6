"""Personal data: pattern spans, and terms that give protected entities away by corpus co-occurrence.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, id_back, long_id, written

#: The kinds in their order, with patterns that match as the published ones do. Possessive repeats and a
#: start that is no continuation of a run keep long runs linear; \G lets a match start where the last one ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"\p{L}{3,}"
SPAN = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all non-overlapping matches, in code points.

    The texts between matches (split) and the matches themselves alternate, so starts are running sums of lengths.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda b, m: F.struct(F.coalesce(b, F.lit(0)).alias("b"), m.alias("m")))
    step = lambda acc, x: F.struct((acc["at"] + x["b"] + F.coalesce(x["m"], F.lit(0))).alias("at"), F.array_append(acc["starts"], acc["at"] + x["b"]).alias("starts"))
    starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])
    return F.zip_with(found, F.slice(starts, 1, F.size(found)), lambda m, s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _of_kind(text: Column, k: int, kind: str, radius: int) -> Column:
    def around(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - radius, F.lit(0)) + 1, F.least(x["s"], F.lit(radius)))
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), before.alias("l"), F.substring(text, x["e"] + 1, F.lit(radius)).alias("r"))

    return F.transform(F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"])), around)


def base_spans(text: Column, radius: int) -> Column:
    """All pattern spans of a text by (start, kind), each with the text up to radius code points around it."""
    parts = []
    for k, kind in enumerate(KINDS):
        near = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        parts.append(F.when(near, _of_kind(text, k, kind, radius)).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def detect(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(__id, __text_hash, __spans) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(long_id(id_col).alias("__id"), text.alias("__text"))
    return rows.select("__id", F.xxhash64("__text").alias("__text_hash"), base_spans(F.col("__text"), radius).alias("__spans"))


def words_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(__text_hash, words) of every different text: its words, lower-cased, each once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))
    return docs.select(F.xxhash64(text).alias("__text_hash"), words.alias("words")).dropDuplicates(["__text_hash"])


def entities_of(found: DataFrame) -> DataFrame:
    """(entity, __text_hash, context): the entities that different texts hold in different surroundings, once a text."""
    one = found.where(F.size("__spans") > 0).select("__text_hash", F.explode("__spans").alias("x"))
    value = F.when(F.col("x.k") >= 2, F.regexp_replace("x.m", "[^0-9]", "")).otherwise(F.lower("x.m"))
    name = F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("x.k") + 1), value)
    one = one.select("__text_hash", name.alias("entity"), F.xxhash64("x.l", "x.r").alias("context"))
    one = written(one.groupBy("entity", "__text_hash").agg(F.min("context").alias("context")), "entities")
    often = one.groupBy("entity").agg(F.min("context").alias("c1"), F.max("context").alias("c2"), F.count("*").alias("n_e")).where("c1 <> c2").select("entity", "n_e")
    return one.join(written(often, "often"), "entity")


def disclosing(found: DataFrame, words: DataFrame, threshold: float, small: int) -> DataFrame:
    """(term, disclosure) of the terms that disclose an entity to at least threshold, with the largest over its entities.

    disclosure = PMI(term; entity) / IC(entity) over whole texts, equal texts counted once: how many hold both against
    how many hold the term, and the entity's own information. 1 means that the term occurs nowhere else. Pairs need
    two different surroundings of the entity: one passage and its copies are no co-occurrence.
    """
    entities = written(entities_of(found), "repeated")
    pairs = entities.join(words, "__text_hash").select("entity", "n_e", "context", F.explode("words").alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te"), F.min("context").alias("c1"), F.max("context").alias("c2")).where("c1 <> c2").drop("c1", "c2")
    pairs = written(pairs, "pairs")
    terms = written(pairs.select("term").distinct(), "terms")
    corpus = words.select(F.explode("words").alias("term"))
    # Words of interest are few unless the corpus is full of repeated entities; beyond `small` they are not broadcast.
    if terms.count() <= small:
        corpus = corpus.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        corpus = corpus.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    joined = pairs.join(written(corpus, "corpus_terms"), "term")
    information = F.log2(F.greatest(F.lit(float(max(words.count(), 1))) / F.col("n_e"), F.lit(2.0)))
    value = (F.log2(F.col("n_te") / F.col("n_t")) + information) / information
    return joined.select("term", value.alias("disclosure")).where(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 80, threshold: float = 0.9, remove: float = 0.98, small: int = 100_000
) -> DataFrame:
    """One row per row of docs: id, spans (array of start, kind, end, replacement by start and kind), text (sanitised), and its columns.

    Pattern spans become a placeholder of their kind. Terms that disclose an entity to at least threshold become
    "[term]" and those to at least remove go, wherever they stand in any text; those within a pattern span go with it.
    radius is what counts as an entity's surroundings.
    Null texts count as empty and stay null in the text; null ids stay null; repeated rows are treated alike; an
    empty table gives no rows; other columns of docs are kept as they are, whatever their names. Offsets are code
    points, ends exclusive.
    """
    found = written(detect(docs, id_col, text_col, radius), "spans")
    words = written(words_of(docs, text_col), "words")
    pairs = written(disclosing(found, words, threshold, small), "disclosing")
    replacement = F.when(F.col("disclosure") >= remove, F.lit("")).otherwise(F.lit("[term]"))
    hits = words.select("__text_hash", F.explode("words").alias("term")).join(pairs.select("term", replacement.alias("with")), "term")
    hits = written(hits.groupBy("__text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "with"))).alias("__hits")), "hits")
    # A row and its copies have the same spans: one of them carries what is joined to all.
    by_text = found.groupBy("__id", "__text_hash").agg(F.any_value("__spans").alias("__spans")).join(hits, "__text_hash", "left")
    marks = by_text.select("__id", "__text_hash", F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("__spans"), "__hits")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = written(marks, "marks")
    discard(found, words, pairs, hits)
    keyed = docs.withColumns({"__id": long_id(id_col), "__text_hash": F.xxhash64(text)}).join(marks, ["__id", "__text_hash"])
    base = F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.element_at(F.array(*[F.lit(f"[{k}]") for k in KINDS]), x["k"] + 1).alias("with")))
    outside = lambda w: F.map_contains_key("__hits", F.lower(w["m"])) & ~F.exists("__spans", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"]))
    extra = F.transform(F.filter(matches(text, WORD), outside), lambda w: F.struct(w["s"].alias("s"), F.lit(len(KINDS)).alias("k"), w["e"].alias("e"), F.element_at("__hits", F.lower(w["m"])).alias("with")))
    extra = F.when(F.col("__hits").isNotNull(), extra).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,with:string>>"))
    return keyed.withColumn("__marks", F.array_sort(F.concat(base, extra))).drop("__spans", "__hits")


def replaced(text: Column, marks: Column) -> Column:
    """The text with every marked span replaced; of overlapping spans the first is replaced and the rest removed."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["with"])).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(marks, start, step)
    return F.when(F.size(marks) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text) - done["at"])))


def _joined(marks: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.concat_ws(",", F.transform(marks, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Counts and digests per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms. Edge cases as for sanitise."""
    rows = sanitise(docs.select(id_col, text_col), id_col, text_col, **how)
    base = F.filter("__marks", lambda x: x["k"] < len(KINDS))
    count = lambda k: F.size(F.filter("__marks", lambda x: x["k"] == k)).cast("long")
    return rows.select(id_back("__id").alias(id_col), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("__marks")).alias("spans"), count(len(KINDS)).alias("n_terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the text sanitised; all other columns as they were. Edge cases as for sanitise."""
    rows = sanitise(docs, id_col, text_col, **how)
    return rows.withColumn(text_col, replaced(F.col(text_col), F.col("__marks"))).select(*docs.columns)
