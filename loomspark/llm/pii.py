"""Personal data by patterns, and terms that disclose it by corpus co-occurrence.

DataFrame functions only.  Spans of a pattern come from ``split`` and
``regexp_extract_all`` with one pattern: the pieces between and the matches
add up to code point offsets, by running sums that double their reach, so a
text of n matches takes n log n steps.

Disclosure: an entity is a normalised value (an address, a number).  A term is
a word outside of the base spans: one of 4 letters or more in lower case, or a
shorter one that begins like a name, as it is written.  With N documents, c(e)
and c(t) of them holding entity and term, and c(t,e) holding both, anywhere in
their whole texts, the entity's information is log(N / c(e)), and the term's
share of it is log(c(t,e) N / (c(t) c(e))) / log(N / c(e)).  A term that shares
at least ``support`` documents with an entity discloses it if its share reaches
the threshold.  Such a term is a span wherever it stands, in documents without
the entity too.  ``find`` gives the spans; ``clean`` puts general names in
place: the kind of an entity, and of a term whether it is written like a name.

Statistics: document counts of all words of all documents, by aggregates with
a map-side step; entities and pairs count once a document, so a hot entity is
as cheap as any other.

Defined cases: null text counts as empty and has no spans; a null id is kept;
rows that repeat id and text get the same spans and count once for entities;
of spans that overlap, ``clean`` keeps the first general name, and of equal
starts the shorter span's; an empty table gives no rows; a very long text is
one like any other; other columns are kept by ``clean``, under any name, and
ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut_lineage, fresh

KINDS = ("email", "ip", "card", "phone", "term")
# fixed values: the base patterns, with possessive repeats and anchors that keep a search linear and change no kept match
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# 13 digits at least: a shorter run of digits holds no card, so the first 13 that are found begin where the run begins
CARD = r"[0-9](?:[ -]?+[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
#: Terms: words of 4 letters or more, and shorter ones that begin like a name.
TERM = r"\p{L}{4,}+|(?<!\p{L})[\p{Lu}\p{Lt}\p{Lo}]\p{L}{0,2}(?!\p{L})"
LIKE_A_NAME = r"^[\p{Lu}\p{Lt}\p{Lo}]"
#: Documents that a term must share with an entity, and the share of the entity's information that it must give.
SUPPORT, SHARE = 2, 0.8
#: Bytes, of seven bits each, of the filter that tells most words that are no disclosing terms before they are shuffled.
SIEVE = 1 << 18
PUT = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "name": "[NAME]", "term": "[TERM]"}
#: Characters of the pieces that a text is cut into to be rebuilt: places in a string are counted from its start.
PIECE = 4096
SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join) -> Column:
    """``join`` of all values up to each place; every step doubles the reach, so n values take n log n steps."""
    reaches = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(reaches, values, lambda held, reach: F.transform(held, lambda x, i: F.when(i >= reach, join(x, F.get(held, i - reach))).otherwise(x)))


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value), leftmost and without overlaps; code points, the end exclusive."""

    def spans(found):
        def placed(pieces):
            lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
            return F.zip_with(found, running(lengths, lambda a, b: a + b), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)  # a column stays one


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc, i):
        d = F.ascii(F.substring(digits, n - i, 1)) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.filter(matches(text, IP), lambda x: x["value"].rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
        "card": F.filter(matches(text, CARD), lambda x: F.when(F.length(digits(x["value"])).between(13, 19), luhn(digits(x["value"]))).otherwise(False)),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(digits(x["value"])).between(9, 15))).otherwise(none),
    }
    return found


def digest(kinds: tuple[str, ...]) -> Column:
    def each(kind):  # a default argument would make the function take the index
        return F.transform(F.col(kind), lambda x: F.concat(F.lit(kind + ":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    parts = [each(k) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def report(found: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(KINDS[:4]), 256).alias("base_sha256"), digest(KINDS).alias("spans"))


def between(pieces: Column, low: Column, high: Column) -> Column:
    """The characters from ``low`` to ``high`` of a text that is cut into pieces."""
    i, j = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    apart = F.concat(F.substring(piece(i), low % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(piece(j), F.lit(1), high % PIECE))
    return F.when(i == j, F.substring(piece(i), low % PIECE + 1, high - low)).otherwise(apart)


def rebuilt(text: Column, marks: Column, put) -> Column:
    """The text with ``put(at, mark)`` for its sorted marks (start, end, ...), one at least; ``at`` is where the marks before end."""

    def of_pieces(pieces):
        def of_ends(ends):
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            parts = F.zip_with(marks, before, lambda x, at: F.concat(between(pieces, at, F.greatest(at, x["start"])), put(at, x)))
            return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(ends, -1), F.length(text)))

        return let(running(F.transform(marks, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), of_ends)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of_pieces)


def entity_of(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind == "email" else F.regexp_replace(value, "[^0-9.]" if kind == "ip" else "[^0-9]", ""))


def term_of(word: Column) -> Column:
    return F.when(F.length(word) >= 4, F.lower(word)).otherwise(word)


def blanked(text: Column, marks: Column) -> Column:
    """The text with spaces in place of its sorted marks; as long as before."""
    return F.when(F.size(marks) > 0, rebuilt(text, marks, lambda at, x: F.repeat(F.lit(" "), F.greatest(F.lit(0), x["end"] - F.greatest(at, x["start"]))))).otherwise(text)


def base_marks(put: bool = False) -> Column:
    """The base spans of all kinds, sorted; ``put``: each with its general name."""

    def of(kind):
        name = [F.lit(PUT[kind]).alias("put")] if put else []
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *name))

    return F.array_sort(F.concat(*[of(k) for k in KINDS[:4]]))


def base_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, email, ip, card, phone, entities, words): base spans, different entities, and the different words outside of these spans as written, in a row."""
    spans = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(base_spans(F.col("text")))
    entities = F.array_distinct(F.concat(*[entities_of(k) for k in KINDS[:4]]))
    words = F.array_distinct(F.regexp_extract_all(blanked(F.col("text"), base_marks()), F.lit(TERM), F.lit(0)))
    bare = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS[:4]]
    return spans.select("doc_id", identity(F.col("text")).alias("h"), *bare, entities.alias("entities"), F.array_join(words, " ").alias("words"))


def identity(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def entities_of(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: entity_of(kind, x["value"]))


def words_of(words: str = "words") -> Column:
    """The words that stand in a row; none of an empty one."""
    return F.filter(F.split(words, " "), lambda w: w != "")


def disclosing_terms(base: DataFrame, n_docs: int, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(term): terms that disclose an entity by the documents that hold both.

    c(t,e) is c(e) at most, so a term in more than c(e) (N / c(e)) ** (1 - share)
    documents cannot reach the share; only rarer ones are paired.
    """
    terms = F.array_distinct(F.transform(words_of(), term_of))
    counts = base.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= support)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("h")).alias("key")
    holding = base.filter(F.size("entities") > 0).dropDuplicates(["doc_id", "h"]).select(key, "entities", "words")
    mentions = holding.select("key", F.explode("entities").alias("entity"))
    known = mentions.groupBy("entity").agg(F.count("*").alias("ce")).filter(F.col("ce") >= support)
    known = known.withColumn("most", F.col("ce") * F.pow(F.lit(float(n_docs)) / F.col("ce"), F.lit(1 - share)) * (1 + 1e-9))
    mentions = cut_lineage(mentions.join(known, "entity"))
    most = mentions.agg(F.max("most")).first()[0]
    if most is None:
        return counts.select("term").limit(0)
    said = holding.join(mentions.select("key").distinct(), "key", "left_semi").select("key", F.explode(terms).alias("term"))
    rare = said.join(counts.filter(F.col("df") <= most), "term")
    pairs = mentions.join(rare, "key").filter(F.col("df") <= F.col("most")).groupBy("entity", "term").agg(F.count("*").alias("cte"), F.min("ce").alias("ce"), F.min("df").alias("df"))
    information = F.log(F.lit(float(n_docs)) / F.col("ce"))
    given = F.log(F.col("cte") * F.lit(float(n_docs)) / (F.col("df") * F.col("ce")))
    good = pairs.filter(F.col("cte") >= support).withColumn("share", F.when(information > 0, given / information)).filter(F.col("share") >= share)
    return good.select("term").distinct()


def sieve(good: DataFrame):
    """A test of terms that all of ``good`` pass and few others; its bits, of a fixed size, go with the plan."""
    bits = bytearray(SIEVE)
    place = lambda term: F.pmod(F.xxhash64(term), F.lit(7 * SIEVE)).cast("int")
    at = place(F.col("term"))
    bit = F.call_function("shiftleft", F.lit(1), (at % 7).cast("int"))
    for r in good.groupBy((at / 7).cast("int").alias("byte")).agg(F.bit_or(bit).alias("bits")).collect():  # SIEVE rows at most
        bits[r.byte] = r.bits
    held = F.lit(bytes(bits))

    def passes(term: Column) -> Column:
        byte = F.ascii(F.substring(held, (place(term) / 7).cast("int") + 1, F.lit(1)).cast("string"))
        return F.getbit(byte, place(term) % 7) == 1

    return passes


def term_words(base: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(oh, terms): of each text with disclosing terms, these as it writes them.  The words of a text depend on it alone."""
    good = cut_lineage(disclosing_terms(base, base.count(), support, share))
    passes = sieve(good)
    maybe = base.select(F.col("h").alias("oh"), F.explode(F.filter(words_of(), lambda w: passes(term_of(w)))).alias("word"))
    return maybe.join(good, term_of(F.col("word")) == F.col("term"), "left_semi").groupBy("oh").agg(F.collect_set("word").alias("terms"))


def term_spans(text: Column, marks: Column, terms: Column) -> Column:
    """Spans of the given words outside of the marks."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return matches(blanked(text, marks), pattern)


def find(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(doc_id, h, email, ip, card, phone, term): one row per document, spans by kind."""
    base = cut_lineage(base_table(docs))
    terms = cut_lineage(term_words(base, support, share))
    text = F.coalesce("text", F.lit(""))
    # only texts with disclosing terms are read again, row by row: nothing after the join groups copies of a text, so a hot one is split
    told = docs.select("doc_id", text.alias("text"), identity(text).alias("h")).join(terms, F.col("h") == F.col("oh")).drop("oh").withColumns(base_spans(F.col("text")))
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    with_terms = told.select("doc_id", "h", *[bare(F.col(k)).alias(k) for k in KINDS[:4]], bare(term_spans(F.col("text"), base_marks(), F.col("terms"))).alias("term"))
    without = base.join(terms, F.col("h") == F.col("oh"), "left_anti").select("doc_id", "h", *KINDS[:4], F.array().cast("array<struct<start:int,end:int>>").alias("term"))
    return with_terms.union(without)


def clean(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """The documents with general names in place of personal data and of disclosing terms; all columns stay, ``n_chars`` is renewed."""
    base = cut_lineage(base_table(docs))
    held = base.select("h", *KINDS[:4]).join(term_words(base, support, share), F.col("h") == F.col("oh"), "left").drop("oh")
    some = "terms is not null or " + " or ".join(f"size({k}) > 0" for k in KINDS[:4])
    own, marks, terms = fresh(docs, "h_", "marks_", "terms_")
    held = held.filter(some).dropDuplicates(["h"]).select(F.col("h").alias(own), base_marks(put=True).alias(marks), F.col("terms").alias(terms))
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(held, identity(text) == F.col(own), "left")
    general = lambda word: F.when(word.rlike(LIKE_A_NAME), PUT["name"]).otherwise(PUT["term"])
    named = F.transform(term_spans(text, F.col(marks), F.col(terms)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), general(x["value"]).alias("put")))
    every = F.when(F.col(terms).isNull(), F.col(marks)).otherwise(F.array_sort(F.concat(marks, named)))
    built = let(every, lambda found: rebuilt(text, found, lambda at, x: F.when(x["start"] >= at, x["put"]).otherwise(F.lit(""))))
    new = joined.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(built))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)
