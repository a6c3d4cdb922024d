"""Information-theoretic sanitisation of personal data (operator 3). DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. Each distinct value
is a protected entity c. A term t near a mention of c may reveal c even where the
value itself is gone. How strongly is estimated over the whole corpus:

    disclosure(c, t) = PMI(c; t) / IC(c),  IC(c) = ln(N / df(c)),
    PMI(c; t) = ln(N * df(c, t) / (df(c) * df(t)))

with df counting documents, so it is 1 + ln P(c | t) / IC(c) and 1 where t occurs with c alone.
Terms of all of a document count as near a mention in it. Most values are in one or two documents,
so P(c | t) is smoothed instead of asking for support: ``prior`` documents in which c is
as frequent as everywhere join those of t.

A term whose disclosure reaches a threshold gets a span of kind ``term``. Words with the same first
letters are its general class, for which the same estimate is made: if the class is below the
threshold, the term is generalised to it ("zanzibar" becomes "zan*"), else it is removed. That holds throughout the documents with c.
In all others it holds only where t makes c likelier than not (``likely``), and the estimate leaves out one
document that has both, since a pair is looked at only because one has: so texts that merely share
a rare word with a mention stay as they are.

Cases: a null text is empty; repeated rows are counted and answered one by one; rows of one doc_id with different
texts are told apart by their text; a null doc_id is kept; an empty table gives no
rows; extra columns are ignored, or kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takemark.llm.common import Scratch, let, member_test

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns. Where the first run of characters fails, so does every
# start inside that run; \G lets a match begin where the last one ended.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What every text with a match of the kind contains.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_TERM = "\\p{L}{3,}+"
#: Letters that name the class of a term; the names of classes start with a mark that no term has.
_CLASS_LETTERS, _CLASS_MARK = 3, "*"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def located(text: Column, pattern: str, as_: Callable[[Column], Column] = lambda value: value) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches, in code points, end exclusive.

    value is as_(match); matches for which that is null are left out.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(f: Column, a: Column, i: Column) -> Column:
        start = a["at"] + f["gaps"][i]
        end = start + F.length(f["hits"][i])
        value = as_(f["hits"][i])
        longer = F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"))))
        return F.struct(end.alias("at"), F.when(value.isNull(), a["out"]).otherwise(longer).alias("out"))

    def walk(f: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(f["hits"]) == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(f["hits"]) - 1), first, lambda a, i: step(f, a, i), lambda a: a["out"]))

    return let(found, walk)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, kind, end, value>> of all kinds, by start and then kind as listed."""
    text = F.coalesce(text, F.lit(""))

    def one(rank: int, kind: str) -> Column:
        spans = F.transform(
            F.filter(located(text, PATTERNS[kind]), lambda s: CHECKS[kind](s["value"])),
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
        )
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
        needs = text.rlike("[0-9][\\x20-]?[0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
        return F.when(needs, spans).otherwise(none)

    return F.array_sort(F.concat(*(one(k, kind) for k, kind in enumerate(KINDS))))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _class_of(term: Column) -> Column:
    return F.concat(F.lit(_CLASS_MARK), F.substring(term, 1, _CLASS_LETTERS))


def _with_classes(terms: Column) -> Column:
    """Distinct terms and the distinct classes that they fall in."""
    return F.concat(terms, F.array_distinct(F.transform(terms, _class_of)))


def disclosing_terms(mentions: DataFrame, docs: DataFrame, s: Scratch, text: str = "text", prior: float = 1.0, threshold: float = 0.6, likely: float = 0.5) -> DataFrame:
    """(entity, term, inside, outside): pairs whose disclosure reaches threshold; counts cover all documents.

    mentions: one row (entity, term) per document with both, terms and classes alike. inside and
    outside are the actions in documents with the entity and in others; outside may be null.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    together = s.saved(mentions.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_ct")).where("term is not null"), "together")
    # A document without a term is a row with a null term.
    of_entity = s.saved(mentions.groupBy("entity").agg(F.sum("first").alias("df_c")), "entities")
    of_term = docs.where(F.col(text).isNotNull()).select(F.explode_outer(_with_classes(_terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    # All terms are counted before the join: Spark would push a semi-join below the count, on every occurrence.
    pairs = together.join(of_entity, "entity").join(of_term, "term").crossJoin(n_docs).where(F.col("n_docs") > F.col("df_c"))  # one row on the right
    base = F.col("df_c") / F.col("n_docs")

    def chance(less: int) -> Column:
        """P(c | t), smoothed."""
        return F.least((F.col("df_ct") - less + prior * base) / (F.col("df_t") - less + prior), F.lit(1.0))

    inside, outside = 1 - F.log(chance(0)) / F.log(base) >= threshold, chance(1) >= likely
    scored = s.saved(pairs.select("entity", "term", inside.alias("inside"), (inside & outside).alias("outside")).where("inside"), "scored")
    is_class = F.col("term").startswith(_CLASS_MARK)
    classes = scored.where(is_class).select("entity", F.col("term").alias("class"), F.col("inside").alias("class_in"), F.col("outside").alias("class_out"))
    met = scored.where(~is_class).withColumn("class", _class_of(F.col("term"))).join(classes, ["entity", "class"], "left")

    def action(own: str, general: str) -> Column:
        return F.when(F.col(own), F.when(F.col(general), "remove").otherwise("generalise"))

    return met.select("entity", "term", action("inside", "class_in").alias("inside"), action("outside", "class_out").alias("outside"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prior: float = 1.0, threshold: float = 0.6, likely: float = 0.5) -> DataFrame:
    """(id, _text_hash, base, spans): all spans of every row, array<struct<start, rank, kind, end, value>> in order.

    value is the entity's value, or the action for a term.
    """
    with Scratch(docs.sparkSession) as s:
        return s.keep(_annotated(docs, id_col, text, prior, threshold, likely, s), "annotated")


def _annotated(docs: DataFrame, id_col: str, text: str, prior: float, threshold: float, likely: float, s: Scratch) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(id_col), t.alias("text"), F.xxhash64(t).alias("_text_hash"))
    based = read.select(id_col, "_text_hash", "text", base_spans(F.col("text")).alias("base"))
    based = based.withColumn("terms", F.when(F.size("base") > 0, _terms(_replaced(F.col("text"), F.col("base"), lambda x: F.lit(" ")))))
    rows = s.saved(based.drop("text"), "spans")
    row = F.struct(F.col(id_col).alias("id"), "_text_hash").alias("_row")
    entities = F.array_distinct(F.transform("base", lambda x: F.concat(x["kind"], F.lit(":"), x["value"])))
    each = rows.where("size(base) > 0").select(row, F.explode_outer(entities).alias("entity"), _with_classes(F.col("terms")).alias("terms"))
    mentions = each.select("_row", "entity", F.posexplode_outer("terms").alias("place", "term")).withColumn("first", F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0))
    flagged = s.saved(disclosing_terms(mentions, docs, s, text, prior, threshold, likely), "flagged")
    inside = mentions.join(flagged, ["entity", "term"]).select("_row", "term", F.col("inside").alias("action"))
    # A term that several entities ask for is removed if any of them does.
    anywhere = s.saved(flagged.where("outside is not null").groupBy("term").agg(F.max("outside").alias("action")), "anywhere")
    asked_for = member_test(anywhere.select(F.xxhash64("term").alias("v")), s)
    # Few words of all texts are shuffled: those that may be asked for.
    words = read.select(row, F.explode_outer(_terms(F.col("text"))).alias("term")).where(asked_for(F.xxhash64("term")))
    outside = words.join(anywhere, "term").select("_row", "term", "action")
    hits = s.saved(inside.unionByName(outside).groupBy("_row", "term").agg(F.max("action").alias("action")), "hits")
    asked = hits.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("asked")).select(F.col("_row.id").alias("_id"), F.col("_row._text_hash").alias("_hash"), "asked")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    places = located(F.col("text"), _TERM, lambda v: F.element_at(F.col("asked"), F.lower(v)))
    extra = F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    asked = s.saved(asked, "asked")
    marked = member_test(asked.select(F.xxhash64("_id", "_hash").alias("v")), s)
    found = s.saved(read.where(marked(F.xxhash64(id_col, "_text_hash"))).join(asked, same).select("_id", "_hash", extra.alias("extra")).dropDuplicates(["_id", "_hash"]), "extra")
    clear = F.filter("extra", lambda e: ~F.exists("base", lambda o: (e["start"] < o["end"]) & (o["start"] < e["end"])))
    return rows.join(found, same, "left").select(id_col, "_text_hash", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, digest of the base spans and list of all spans."""

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count("base", k) for k in KINDS]
    return annotated.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("spans", "term"))


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with mark(span) in place of each span."""
    pieces = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), mark(s)))
        inside = s["start"] < a["at"]  # begins in a span that is already replaced
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(put).alias("out"))

    first = F.struct(F.lit(0).alias("at"), pieces.alias("out"))
    whole = F.aggregate(spans, first, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by <KIND>, removed terms dropped and generalised ones as their class."""
    general = lambda s: F.concat(F.substring(text, s["start"] + 1, F.lit(_CLASS_LETTERS)), F.lit(_CLASS_MARK))
    return _replaced(text, spans, lambda s: F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", F.lit("")).otherwise(general(s)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """docs with their text redacted; all other columns as they were. Texts that have spans move, others stay where they are."""
    s = Scratch(docs.sparkSession)  # not left: its two small tables are what the result reads
    found = annotate(docs.select(id_col, text), id_col, text, **parameters).where("size(spans) > 0")
    found = s.saved(found.select(F.col(id_col).alias("_pii_id"), F.col("_text_hash").alias("_pii_hash"), F.col("spans").alias("_pii_spans")).distinct(), "found")
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = member_test(found.select(F.xxhash64("_pii_id", "_pii_hash").alias("v")), s)(F.xxhash64(F.col(id_col), text_hash))
    same = F.col(id_col).eqNullSafe(F.col("_pii_id")) & (text_hash == F.col("_pii_hash"))
    joined = docs.where(marked).join(found, same, "left")
    redone = joined.withColumn(text, F.when(F.col("_pii_spans").isNotNull(), redacted(F.col(text), F.col("_pii_spans"))).otherwise(F.col(text))).select(*docs.columns)
    return docs.where(~marked).unionByName(redone)
