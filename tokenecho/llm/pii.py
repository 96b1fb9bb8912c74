"""Personal data and the terms that disclose it, with DataFrame functions only.

Base spans are emails, IP addresses, card and phone numbers. Then the corpus says how
strongly a term beside an entity (one base value) in a document reveals it: with document
counts, PMI(c; t) = ln(N n(c,t) / (n(c) n(t))) is compared with the entity's information
content IC(c) = ln(N / n(c)); the ratio is 1 when all documents with the term hold that
entity. Terms from the removal threshold up are removed, those from the disclosure threshold
up generalised, wherever they stand in the documents that hold an entity that they disclose.
Counts cover whole documents, and all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
# Possessive and anchored forms of the patterns: they find the same matches in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: A term: a run of letters outside emails, of any length; how many matches have their starts added up at once.
TERM, STRETCH = r"\p{L}+", 256
#: Documents that hold both the term and the entity, at least; ratios of PMI to IC.
SUPPORT, DISCLOSES, REMOVES = 3, 0.9, 0.99
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _starts(sizes: Column, gaps: Column) -> Column:
    """0-based starts of stretches with these sizes, each behind a gap."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("g"), sizes.alias("m")), state, step, lambda acc: acc["out"])


def _located(matches: Column, pieces: Column) -> Column:
    """array<struct<t, s>>: matches and their 0-based starts, from the pieces between them.

    Starts are added up by stretches, so that time is not the square of the matches.
    """
    lengths = lambda x: F.transform(x, F.length)

    def cut(x: Column) -> Column:
        begin = F.when(F.size(x["m"]) > 0, F.sequence(F.lit(1), F.size(x["m"]), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
        return F.transform(begin, lambda i: F.struct(lengths(F.slice(x["p"], i, F.lit(STRETCH))).alias("p"), F.slice(x["m"], i, F.lit(STRETCH)).alias("m")))

    def placed(parts: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
        whole = F.transform(parts, lambda y: total(F.slice(y["p"], F.lit(1), F.size(y["m"]))) + total(lengths(y["m"])))
        offset = _starts(whole, F.transform(parts, lambda y: F.lit(0)))
        return F.flatten(F.zip_with(parts, offset, lambda y, o: F.zip_with(y["m"], _starts(lengths(y["m"]), F.slice(y["p"], F.lit(1), F.size(y["m"]))), lambda t, s: F.struct(t.alias("t"), (o + s).alias("s")))))

    # arrays of one element bind what the inner functions use, or they would find it anew for every stretch
    both = F.struct(pieces.alias("p"), matches.alias("m"))
    return F.flatten(F.transform(F.transform(F.array(both), cut), placed))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


_RULES = {
    "email": (EMAIL, lambda v: F.lit(True), lambda v: F.translate(v, _UP, _LOW), "@"),
    "ip": (IP, lambda v: v.rlike(IP_VALID), lambda v: v, "."),
    "card": (CARD, lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)), _digits, None),
    "phone": (PHONE, lambda v: F.length(_digits(v)).between(9, 15), _digits, "+"),
}


def _span(i: int, k: str, valid, entity):
    def span(x: Column) -> Column:
        v, start = x["t"], x["s"]
        return F.when(valid(v), F.struct(start.alias("start"), F.lit(i).alias("kind"), (start + F.length(v)).alias("end"), F.concat(F.lit(f"{k}:"), entity(v)).alias("entity")))

    return span


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with base: array<struct<start, kind (int), end, entity>> by start, and masked: the text without emails."""
    some = lambda sign: F.col(text).contains(sign) if sign else F.lit(True)
    keep = rows.columns
    out = rows.select(*keep, *[F.when(some(sign), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"m_{k}") for k, (pattern, _, _, sign) in _RULES.items()])
    out = out.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(F.col(text), pattern, -1)).alias(f"p_{k}") for k, (pattern, *_) in _RULES.items()])
    found = []
    for i, (k, (_, valid, entity, _)) in enumerate(_RULES.items()):
        m = F.col(f"m_{k}")
        spans = F.filter(F.transform(_located(m, F.col(f"p_{k}")), _span(i, k, valid, entity)), lambda x: x.isNotNull())
        found.append(F.when(F.size(m) > 0, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,entity:string>>")))
    hidden = F.zip_with("p_email", "m_email", lambda p, m: F.concat(p, F.coalesce(F.repeat(F.lit("#"), F.length(m)), F.lit(""))))
    return out.select(*keep, F.array_sort(F.concat(*found)).alias("base"), F.when(F.size("m_email") > 0, F.array_join(hidden, "")).otherwise(F.col(text)).alias("masked"))


def _words(text: Column) -> Column:
    """The distinct terms of a text, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UP, _LOW), F.lit(TERM), F.lit(0)))


def _occurrences(text: Column) -> Column:
    """All terms of a text: array<struct<t, s, e>>."""
    found = _located(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1))
    return F.transform(found, lambda x: F.struct(F.translate(x["t"], _UP, _LOW).alias("t"), x["s"].alias("s"), (x["s"] + F.length(x["t"])).alias("e")))


def _is(i: int):
    return lambda x: x["kind"] == i


def _joined(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def disclosing_terms(documents: DataFrame, held: DataFrame, entities: DataFrame) -> DataFrame:
    """(c, t, kind): terms whose presence beside an entity passes a threshold.

    held: key, masked, m and entities (of at least SUPPORT documents) of the texts that have any, which m rows share.
    """
    n = documents.count()
    hidden = F.when(F.col("text").contains("@"), F.regexp_replace("text", EMAIL, "#")).otherwise(F.col("text"))
    words = documents.select(F.explode(_words(hidden)).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= SUPPORT)
    pairs = held.select("m", F.explode("entities").alias("c"), _words(F.col("masked")).alias("words")).select("m", "c", F.explode("words").alias("t"))
    pairs = pairs.groupBy("c", "t").agg(F.sum("m").alias("n_ct")).where(F.col("n_ct") >= SUPPORT)
    scored = pairs.join(words, "t").join(entities, "c")
    pmi = F.log(F.lit(float(n)) * F.col("n_ct") / F.col("n_c") / F.col("n_t"))
    ic = F.log(F.lit(float(n)) / F.col("n_c"))
    scored = scored.withColumn("ratio", pmi / ic).where(F.col("n_c") < n).where(F.col("ratio") >= DISCLOSES)
    return scored.select("c", "t", F.when(F.col("ratio") >= REMOVES, F.lit(4)).otherwise(F.lit(5)).alias("kind"))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (row_key of id and text), n_email, n_ip, n_card, n_phone, base_sha256, spans and all (start, kind, end) of every row.

    A null text is empty and has no spans. Rows with null or repeated ids each get their
    own result (equal rows count as so many documents and are alike); an empty table gives
    no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key("doc_id", "text"))
    found = base_spans(rows).select("doc_id", "key", "base", F.when(F.size("base") > 0, F.col("masked")).alias("masked"))
    found = scratch.save(found, "found")
    some = found.where("size(base) > 0")
    beside = some.select("key", F.explode(F.array_distinct(F.transform("base", lambda b: b["entity"]))).alias("c")).groupBy("key", "c").agg(F.count("*").alias("m"))
    entities = beside.groupBy("c").agg(F.sum("m").alias("n_c")).where(F.col("n_c") >= SUPPORT)
    beside = beside.join(entities, "c").groupBy("key").agg(F.max("m").alias("m"), F.collect_list("c").alias("entities"))
    held = scratch.save(some.select("key", "masked").dropDuplicates(["key"]).join(beside, "key"), "held")
    flagged = scratch.save(disclosing_terms(rows.select("text"), held, entities), "terms")

    near = held.select("key", F.explode("entities").alias("c"), _words(F.col("masked")).alias("words")).select("key", "c", F.explode("words").alias("t"))
    near = near.join(flagged, ["c", "t"]).groupBy("key", "t").agg(F.min("kind").alias("kind"))
    near = held.select("key", F.explode(_occurrences(F.col("masked"))).alias("x")).select("key", "x.*").join(near, ["key", "t"])
    near = near.groupBy("key").agg(F.collect_list(F.struct(F.col("s").alias("start"), "kind", F.col("e").alias("end"))).alias("added"))
    out = found.drop("masked").join(near, "key", "left")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = out.select("doc_id", "key", base.alias("base"), "added")
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", "key", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), both.alias("all")).withColumn("spans", _joined(F.col("all")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of find_private replaced in the text; rows without any, and null texts, stay as they are.

    Rows with null or repeated ids are each treated by their own text; an empty table stays
    empty; columns of any name come back as they were.
    """
    spans = find_private(docs, id_col, text_col).where("size(all) > 0").dropDuplicates(["key"]).select("key", "all")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(f"`{id_col}`", f"`{text_col}`").alias("key"))
    out, text = keyed.join(spans, "key", "left"), F.col("row")[text_col]
    text = F.when(F.col("all").isNotNull(), redact(text, F.col("all"))).otherwise(text)
    return out.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def redact(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: base data and generalised terms by their kind, removed terms by nothing.

    spans as in `all` of find_private: by start; a span that starts inside an earlier one is
    part of it. Stretches of spans work on their own part of the text, so that time is not
    the square of its length.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:4]], F.lit(""), F.lit("<TERM>"))
    state = lambda at: F.struct(at.alias("at"), F.lit("").alias("out"))

    def within(y: Column) -> Column:
        """What a stretch y (at, spans, part: the text from at to the stretch's end) gives."""

        def step(acc: Column, x: Column) -> Column:
            fresh = x["start"] >= acc["at"]
            piece = F.concat(acc["out"], F.substring(y["part"], acc["at"] - y["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

        return F.aggregate(y["spans"], state(y["at"]), step)

    def stretch(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(x, lambda v: v["end"])))
        own = F.struct(acc["at"].alias("at"), x.alias("spans"), F.substring(text, acc["at"] + 1, end - acc["at"]).alias("part"))
        got = F.element_at(F.transform(F.transform(F.array(own), within), lambda v: F.struct(v["at"].alias("at"), F.concat(acc["out"], v["out"]).alias("out"))), 1)
        return got

    cut = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(STRETCH)), lambda i: F.slice(spans, i, F.lit(STRETCH)))
    return F.aggregate(cut, state(F.lit(0)), stretch, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
