"""Personal data: base patterns, and terms that disclose the protected entities.

Base spans come from regular expressions over the whole text. Each span names two
protected entities: its exact value, and its owner (the domain of an address,
the network of an ip, the issuer of a card, the area of a phone number), since
most values occur in one text only. Terms of the same documents are judged by
corpus co-occurrence. With document frequencies ``df`` over all documents, a
document of term ``t`` holds entity ``e`` with the chance
``p(e | t) = (df(t, e) + df(e) / N) / (df(t) + 1)``, one document at the base rate
being added so that rare terms do not tell by accident, and ``t`` reveals
``log2(p(e | t) * N / df(e))`` bits of the entity's own information
``IC(e) = log2(N / df(e))``. Terms at or above ``disclosure`` of it are generalised, at
or above ``removal`` removed, at all their places in documents of the entity. All
of it is DataFrame and SQL functions.

The patterns are written with possessive runs and look-behinds, which accept
the same matches as the plain forms in linear time.

Defined results: null text is empty and has no spans; repeated rows are judged
alike and each counts as a document; null ids are carried; an empty table gives
an empty result; only doc_id and text are read, and what is added takes names that
no column has; offsets are code points, ends exclusive; a text of any length is
searched in time that grows with its length and its number of spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coffer.llm.common import columns_of, drop_table, fresh, materialize, spread_join, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (cheap test that any accepted match satisfies, pattern)
PATTERNS = {
    "email": ("@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
TERM = r"[\p{L}\p{M}]{3,}"
_BLOCK = 256
#: Terms beside entities that are broadcast at most; with more, terms are counted before they are chosen.
BROADCAST_TERMS = 200_000


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the matches of ``pattern``, in code points.

    Starts are prefix sums of piece and match lengths, in blocks, so that a
    text of very many matches is not summed anew for each.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("value")))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def placed(rows: Column, steps: Column, sums: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = x.gap + total(F.slice(sums, F.lit(1), block)) + total(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK))
            return F.struct(start.alias("start"), (start + x.n).alias("end"), x.value.alias("value"))

        return F.transform(rows, one)

    # each level is bound once by a one-element transform
    def with_sums(rows: Column, steps: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _BLOCK).cast("int")), lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
        return F.transform(F.array(sums), lambda s: placed(rows, steps, s))[0]

    def with_steps(rows: Column) -> Column:
        return F.transform(F.array(F.transform(rows, lambda x: x.gap + x.n)), lambda s: with_sums(rows, s))[0]

    return F.transform(F.array(both), with_steps)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def doubled(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    figures = F.transform(F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != ""), doubled)
    return F.aggregate(figures, F.lit(0), lambda s, x: s + x) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start,end,value>> of one kind of base span."""
    cheap, pattern = PATTERNS[kind]
    likely = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(cheap))
    return F.when(likely, F.filter(_located(text, pattern), lambda s: _accepted(kind, s.value))).otherwise(F.array().cast(_SPAN))


def found_spans(text: Column) -> Column:
    """array<struct<start,rank,kind,end,value>>: the base spans by start, then kind."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def ranked(kind: str):
        order = KINDS.index(kind)
        return lambda s: F.struct(s.start.alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), s.end.alias("end"), F.lower(s.value).alias("value"))

    return F.array_sort(F.concat(*[F.transform(base_spans(whole, k), ranked(k)) for k in KINDS]))


def owner(span: Column) -> Column:
    """Who a span's value belongs to, by its kind."""
    digits = _digits(span["value"])
    by_kind = F.when(span["kind"] == "email", F.substring_index(span["value"], "@", -1)).when(span["kind"] == "ip", F.substring_index(span["value"], ".", 3))
    return by_kind.when(span["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def _occurrences(found: DataFrame) -> DataFrame:
    """(row, print, term, start, end): all terms of the texts that lie outside all base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    terms = found.select("row", "print", F.explode(_located(text, TERM)).alias("t")).select("row", "print", F.lower("t.value").alias("term"), "t.start", "t.end")
    # spans and terms of a row in one order: a term is free if no earlier span reaches it and none starts in it
    taken = found.select("row", F.explode("spans").alias("s")).select("row", "s.start", F.col("s.end").alias("span_end"))
    both = terms.unionByName(taken, allowMissingColumns=True)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    span_start = F.when(F.col("span_end").isNotNull(), F.col("start"))
    both = both.withColumn("reached", F.max("span_end").over(before)).withColumn("next", F.min(span_start).over(after))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return both.where(F.col("span_end").isNull() & free).select("row", "print", "term", "start", "end")


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosure: float, removal: float, value_support: int, owner_support: int) -> DataFrame:
    """(row, terms): array<struct<start,end,removed>> of the terms to hide; ``found`` has row, print, text and spans.

    A term is beside an entity in every document that holds both, wherever they
    stand. Copies of one text are one piece of evidence: a term needs
    ``value_support`` different texts with a value, ``owner_support`` with an owner.
    """
    total = docs.count()
    spans = found.select("row", "print", F.explode("spans").alias("s"))
    named = F.array(F.struct(F.lit(False).alias("owned"), F.concat_ws(":", "s.kind", "s.value").alias("entity")), F.struct(F.lit(True).alias("owned"), F.concat_ws("@", F.col("s.kind"), owner(F.col("s"))).alias("entity")))
    mentions = spans.select("row", "print", F.explode(named).alias("e")).select("row", "print", "e.entity", "e.owned").distinct()
    least = F.when(F.col("owned"), F.lit(owner_support)).otherwise(F.lit(value_support))
    entities = mentions.groupBy("entity", "owned", "print").agg(F.count("*").alias("n")).groupBy("entity", "owned").agg(F.sum("n").alias("df_e"), F.count("*").alias("support"))
    entities = materialize(entities.where(F.col("support") >= least).select("entity", "df_e", F.col("df_e").alias("n")), "entities")
    # an owner may stand in a large share of the documents
    mentions = materialize(spread_join(mentions, entities, "entity").select("row", "entity", "owned", "df_e"), "mentions")
    # texts with spans may crowd in a few files
    held = found.where(F.size("spans") > 0).join(mentions.select("row").distinct(), "row", "left_semi").repartition("row")
    places = materialize(_occurrences(held), "places")
    # as df_te <= df_e, a term of more documents than this cannot tell enough of the entity
    n = F.lit(float(max(total, 1)))
    most = (n + 1) * F.pow(F.col("df_e") / n, F.lit(disclosure)) * F.lit(1 + 1e-6)
    limit = mentions.agg(F.max(most)).first()[0]
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))
    if limit is None:
        words = words.limit(0)  # no entity has support
    beside = materialize(places.select("term").distinct(), "beside")
    # the frequencies cover all documents; few terms are chosen before they are counted, many after
    if few := beside.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(beside), "term", "left_semi")
    frequency = words.groupBy("term").agg(F.count("*").alias("df_t")).where(F.col("df_t") <= F.lit(limit or 0.0))
    if not few:
        frequency = frequency.join(beside, "term", "left_semi")
    evidence = places.select("row", "print", "term").distinct().join(frequency, "term").join(mentions, "row").where(F.col("df_t") <= most)
    evidence = materialize(evidence.select("row", "print", "entity", "owned", "term", "df_e", "df_t"), "evidence")
    pairs = evidence.groupBy("entity", "owned", "term", "print").agg(F.count("*").alias("n"), F.first("df_e").alias("df_e"), F.first("df_t").alias("df_t"))
    pairs = pairs.groupBy("entity", "owned", "term").agg(F.sum("n").alias("df_te"), F.count("*").alias("support"), F.first("df_e").alias("df_e"), F.first("df_t").alias("df_t"))
    chance = (F.col("df_te") + F.col("df_e") / n) / (F.col("df_t") + 1)
    information = F.log2(n / F.col("df_e"))
    told = pairs.where(F.col("support") >= least).withColumn("told", F.when(information > 0, F.log2(chance * n / F.col("df_e")) / information).otherwise(0.0))
    told = told.where(F.col("told") >= disclosure).select("entity", "term", (F.col("told") >= removal).alias("removed"))
    hidden = evidence.join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("removed").alias("removed"))
    hits = places.join(hidden, ["row", "term"])
    hits = materialize(hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms")), "hits")
    for done in (entities, mentions, places, beside, evidence):
        drop_table(done)
    return hits


@dataclass
class Found:
    """Documents with what has to be hidden: the names of the columns of base spans and of disclosing terms."""

    docs: DataFrame
    spans: str
    terms: str


def sanitise(docs: DataFrame, disclosure: float = 0.8, removal: float = 0.95, value_support: int = 2, owner_support: int = 3, keep_text: bool = True) -> Found:
    """All columns of ``docs``, and what has to be hidden.

    The searched rows are written once, so that rows keep their number; without
    ``keep_text`` only texts with spans are written, and none is returned.
    """
    row, mark, spans, hidden = fresh(docs, "row", "print", "spans", "terms")
    searched = docs.withColumn(spans, found_spans(F.col("text"))).withColumn(row, F.monotonically_increasing_id()).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    searched = materialize(searched if keep_text else searched.withColumn("text", F.when(F.size(spans) > 0, F.col("text"))), "personal")
    found = searched.select(F.col(row).alias("row"), F.col(mark).alias("print"), "text", F.col(spans).alias("spans"))
    terms = disclosing_terms(docs, found, disclosure, removal, value_support, owner_support).select(F.col("row").alias(row), F.col("terms").alias(hidden))
    empty = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    # only rows with spans have terms, so that the others stay where they are
    bare, spanned = searched.where(F.size(spans) == 0).withColumn(hidden, empty), searched.where(F.size(spans) > 0)
    spanned = spanned.join(terms, row, "left").select(*columns_of(spanned), F.coalesce(hidden, empty).alias(hidden))
    return Found(bare.unionByName(spanned).drop(row, mark, *([] if keep_text else ["text"])), spans, hidden)


#: Code points of the pieces that a text is cut into before parts of it are taken.
PIECE = 4096


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text that ``pieces`` make up, without counting from its beginning."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    within = F.substring(F.get(pieces, first), start - first * PIECE + 1, end - start)
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(F.get(pieces, first), start - first * PIECE + 1, F.lit(PIECE)), middle, F.substring(F.get(pieces, last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, within).otherwise(across)


def masked(text: Column, spans: Column, terms: Column) -> Column:
    """``text`` with base spans as ``[KIND]``, disclosing terms as ``[TERM]`` or nothing; where spans overlap the earlier start wins."""
    cuts = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), F.concat(F.lit("["), F.upper(s.kind), F.lit("]")).alias("put"))),
        F.transform(terms, lambda t: F.struct(t.start.alias("start"), (-t.end).alias("back"), F.when(t.removed, F.lit("")).otherwise(F.lit("[TERM]")).alias("put"))),
    ))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(pieces: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            free = F.struct(F.negative(c.back).alias("at"), F.concat(s.out, F.array(_part(pieces, s.at, c.start), c.put)).alias("out"))
            return F.when(c.start >= s.at, free).otherwise(s)

        return F.aggregate(cuts, nothing, step, lambda s: F.concat(F.array_join(s.out, ""), _part(pieces, s.at, F.length(text))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # bound once by a one-element transform
    return F.when((F.size(spans) == 0) & (F.size(terms) == 0), text).otherwise(F.transform(F.array(pieces), cut)[0])


def hide(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data and disclosing terms masked in ``text``; a null text stays null. Options as in :func:`sanitise`."""
    found = sanitise(docs, **options)
    (made,) = fresh(found.docs, "hidden")
    text = F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col(found.spans), F.col(found.terms)))
    kept = [F.col(made).alias("text") if c == "text" else x for c, x in zip(docs.columns, columns_of(docs), strict=True)]
    return found.docs.withColumn(made, text).select(*kept)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    plain = F.transform(found.spans, lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.kind.alias("kind"), s.end.alias("end")))
    terms = F.transform(found.terms, lambda t: F.struct(t.start.alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), t.end.alias("end")))
    counts = [F.expr(f"cast(size(filter({found.spans}, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.docs.select("doc_id", *counts, F.sha2(_listed(plain), 256).alias("base_sha256"), _listed(F.array_sort(F.concat(plain, terms))).alias("spans"))
