"""Personal data, and the terms that reveal it, found and taken out; SQL functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers, found by patterns and checks. A term reveals an entity as far as it
tells that the entity is near: with N words in the corpus, n(e) of them within
``window`` words of mentions of an entity e, n(t) places of a term t and n(e, t)
of these near e, the pointwise mutual information log2(N n(e, t) / (n(e) n(t)))
is compared with the entity's own information log2(N / n(e)). A term whose share
of it reaches ``threshold``, and that stands near e in at least ``contexts``
different contexts (so that copies of one text are no evidence), discloses e: in
every document that mentions e it is generalised (digits to 0, then to its first
letters and ``*``), each form weighed by the same measure, or else removed.

Counts cover the whole corpus and are sums over words, so they are made before
any shuffle. Only documents with an entity have their text stored and read
again; joins on an entity, which may have a large share of all mentions, are
dealt over salts.

Positions are code points, ends exclusive. Per kind, matches are leftmost and do
not overlap; kinds may overlap each other. Where they do, the earlier match (of
the first kind among equal starts) is the entity that terms are weighed against.

Defined cases: null texts are empty; texts of any length are read whole; patterns
neither go back nor start within a run of the same characters, so their work is
in proportion to the text; keys may be null or repeated, and repeated rows stay
repeated; between two mentions of one entity a word counts for both, but no term
more often than it occurs; an empty table gives no row; the result has its own
columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import stored

#: Words on each side of a mention; the share of an entity's information that a
#: term may tell; contexts that make it evidence.
WINDOW, THRESHOLD, CONTEXTS = 10, 0.8, 2
SALTS = 16
KINDS = ("email", "ip", "card", "phone")
#: Stands before a mention among the words of a text.
MARK = "\x01"
BLANK, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]++"
#: The patterns, written so that no start within a run is tried: a match from
#: there would be part of one from the run's start, or follow the match before.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold to have a match that passes its check.
_HINTS = {"email": "@[A-Za-z0-9-]++\\.", "ip": PATTERNS["ip"], "card": "[0-9](?:[ -]?[0-9]){15}", "phone": "\\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an expression that stands within a
    lambda is computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Whether a number's check digit is right."""

    def total(text: Column) -> Column:
        n = F.length(text)

        def part(i: Column) -> Column:
            d = F.substring(text, n - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda sum_, i: sum_ + part(i))

    return _let(digits, total) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(f"\\A{_BYTE}(?:\\.{_BYTE}){{3}}\\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts, from the lengths of the matches and of the texts
    between them: sums within blocks, and of whole blocks."""
    whole = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    every = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int"))
    before = F.transform(gaps, F.length)
    sizes = F.zip_with(before, F.transform(matches, F.length), lambda g, m: g + F.coalesce(m, F.lit(0)))

    def places(sums: Column) -> Column:
        blocks = F.transform(every, lambda b: whole(F.slice(sums, b * _BLOCK + 1, F.lit(_BLOCK))))
        ahead = _let(blocks, lambda held: F.transform(held, lambda _, b: whole(F.slice(held, F.lit(1), b))))
        within = lambda old: F.transform(before, lambda g, i: F.get(old, block(i)) + whole(F.slice(sums, block(i) * _BLOCK + 1, i % _BLOCK)) + g)
        return _let(ahead, within)

    return F.slice(_let(sizes, places), F.lit(1), F.size(matches))


_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _span(kind: int) -> Callable[[Column, Column], Column]:
    return lambda at, m: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value"))


def _passing(kind: int, spans: Column) -> Column:
    return F.filter(spans, lambda s: valid(KINDS[kind], s["value"]))


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``spans``, the matches that pass, by kind and then start."""
    none = F.array().cast(_SPANS)
    for i, kind in enumerate(KINDS):
        some = F.col(text).rlike(_HINTS[kind])
        docs = docs.withColumns({"_m": F.when(some, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)), "_g": F.when(some, F.split(text, PATTERNS[kind], -1))})
        docs = docs.withColumn("_at", F.when(F.size("_m") > 0, _starts(F.col("_g"), F.col("_m"))))
        docs = docs.withColumn(f"_{kind}", F.coalesce(_passing(i, F.zip_with("_at", "_m", _span(i))), none)).drop("_m", "_g", "_at")
    return docs.withColumn("spans", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def _term(word: Column) -> Column:
    """A word in lower case without the marks around it."""
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]++|[^\\p{L}\\p{N}]+$", ""))


def _forms(term: Column) -> Column:
    """The term's own form and its generalisations, each wider than the one before."""
    digits = F.regexp_replace(term, "[0-9]", "0")
    return F.array(*[F.struct(F.lit(i).alias("level"), f.alias("form")) for i, f in enumerate((term, digits, F.concat(F.substring(digits, 1, 3), F.lit("*"))))])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """term and n, its places in the corpus."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), BLANK)).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(_term(F.col("w")).alias("term"), "n").where("term <> ''").groupBy("term").agg(F.sum("n").alias("n"))


def _marked(match: Column) -> Column:
    """A match that passes as one word with MARK before it; others as they are."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    out = match
    for kind in reversed(KINDS):
        name = digits if kind in ("card", "phone") else F.lower(match)
        out = F.when(match.rlike(f"\\A(?:{PATTERNS[kind]})\\z") & valid(kind, match), F.concat(F.lit(f" {MARK}{kind}:"), name, F.lit(" "))).otherwise(out)
    return out


def mentions(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, entity, terms (the words around a mention) and context (their hash)."""
    every = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "ip", "phone", "card"))
    rows = found.withColumns({"_m": F.regexp_extract_all("text", F.lit(every), 0), "_g": F.split("text", every, -1)})
    pieces = F.zip_with("_g", F.transform("_m", _marked), lambda g, m: F.concat(F.translate(g, MARK, " "), F.coalesce(m, F.lit(""))))
    rows = rows.withColumn("_w", _words(F.array_join(pieces, "")))
    places = F.filter(F.transform("_w", lambda w, i: F.when(w.startswith(MARK), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "_w", F.explode(places).alias("_i"))
    sides = F.concat(F.slice("_w", F.greatest(F.col("_i") - window, F.lit(0)) + 1, F.least(F.col("_i"), F.lit(window))), F.slice("_w", F.col("_i") + 2, F.lit(window)))
    terms = F.filter(F.transform(F.filter(sides, lambda w: ~w.startswith(MARK)), _term), lambda t: t != "")
    return rows.select("row", F.substring(F.get("_w", F.col("_i")), 2, 1 << 30).alias("entity"), terms.alias("terms")).withColumn("context", F.xxhash64("terms"))


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _share(near: Column, of_entity: Column, of_term: Column, total: Column) -> Column:
    """What part of an entity's information a term tells."""
    pmi = F.log2(F.least(near, of_term) * total / (of_entity * of_term))
    return F.when(of_entity < total, pmi / F.log2(total / of_entity)).otherwise(0.0)


def disclosing(said: DataFrame, words: DataFrame, threshold: float = THRESHOLD, contexts: int = CONTEXTS) -> DataFrame:
    """entity, term, share, level and form: the terms that reveal an entity by
    ``threshold`` or more, and the least generalisation that doesn't (an empty
    form where all do). ``said`` are mentions, ``words`` the vocabulary."""
    near = said.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    near = stored(near.groupBy("entity", "term").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("contexts")), "terms-near-entities")
    sizes = _spread(near.groupBy("entity").agg(F.sum("near").alias("of_entity")))
    total = F.lit(float(words.agg(F.sum("n")).first()[0] or 0))
    often = _salted(_salted(near.where(F.col("contexts") >= contexts), "term").join(sizes, ["entity", "_salt"]).drop("_salt"), "entity")
    known = often.join(_spread(words.withColumnRenamed("n", "of_term")), ["term", "_salt"]).drop("_salt")
    share = _share(F.col("near"), F.col("of_entity"), F.col("of_term"), total)
    flagged = stored(known.withColumn("share", share).where(F.col("share") >= threshold).select("entity", "term", "share", "of_entity"), "disclosing-terms")
    if flagged.isEmpty():
        return flagged.select("entity", "term", "share", F.lit(2).alias("level"), F.lit("").alias("form"))
    wider = lambda rows: rows.withColumn("_f", F.explode(F.slice(_forms(F.col("term")), 2, 2))).select("*", "_f.*").drop("_f")
    asked = wider(flagged)
    forms = asked.select("level", "form").distinct()
    of_form = wider(words).join(forms, ["level", "form"], "left_semi").groupBy("level", "form").agg(F.sum("n").alias("of_form"))
    pairs = asked.select("entity", "level", "form").distinct()
    near_form = wider(near).join(pairs, ["entity", "level", "form"], "left_semi").groupBy("entity", "level", "form").agg(F.sum("near").alias("near_form"))
    weighed = _salted(asked.join(near_form, ["entity", "level", "form"]), "entity").join(_spread(of_form), ["level", "form", "_salt"])
    safe = weighed.where(_share(F.col("near_form"), F.col("of_entity"), F.col("of_form"), total) < threshold)
    least = safe.groupBy("entity", "term").agg(F.min(F.struct("level", "form")).alias("_least"))
    rows = flagged.join(least, ["entity", "term"], "left")
    return rows.select("entity", "term", "share", F.coalesce("_least.level", F.lit(3)).alias("level"), F.coalesce("_least.form", F.lit("")).alias("form"))


def _term_spans(found: DataFrame, said: DataFrame, terms: DataFrame) -> DataFrame:
    """row and terms: the spans of disclosing terms in the texts that mention
    their entity, apart from those of personal data."""
    hit = _salted(said.select("row", "entity").distinct(), "row").join(_spread(terms.select("entity", "term", "level", "form")), ["entity", "_salt"])
    texts = found.where("text is not null")
    held = texts.select("row", F.explode(F.array_distinct(F.transform(_words(F.col("text")), _term))).alias("term"))
    hit = hit.groupBy("row", "term").agg(F.max(F.struct("level", "form")).alias("_to")).join(held, ["row", "term"])
    own = hit.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "_to.form"))).alias("_own"))
    rows = texts.join(own, "row").withColumns({"_m": F.regexp_extract_all("text", F.lit(WORD), 0), "_g": F.split("text", WORD, -1)})
    rows = rows.withColumn("_at", _starts(F.col("_g"), F.col("_m")))
    spans = F.zip_with("_at", "_m", lambda at, w: F.struct(at.alias("start"), (at + F.length(w)).alias("end"), F.get(F.filter(F.array(F.element_at("_own", _term(w))), lambda v: v.isNotNull()), F.lit(0)).alias("form")))
    spans = F.filter(spans, lambda s: s["form"].isNotNull() & ~F.exists("spans", lambda p: (p["start"] < s["end"]) & (s["start"] < p["end"])))
    return rows.select(F.col("row").alias("_row"), spans.alias("terms"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, threshold: float = THRESHOLD, contexts: int = CONTEXTS) -> DataFrame:
    """Key, spans (kind, start, end and what takes their place, by kind and then
    start; kind ``term`` last) and sanitised, the text with the spans replaced,
    null where there are none and the text stays as it is."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = F.size("spans") > 0
    found = with_spans(rows.withColumn("row", F.monotonically_increasing_id()), "text")
    found = stored(found.select("row", "key", "spans", F.when(some, F.col("text")).alias("text")), "personal-data")
    said = stored(mentions(found.where("text is not null"), window), "mentions")
    words = stored(vocabulary(docs, text), "vocabulary")
    terms = stored(disclosing(said, words, threshold, contexts), "disclosed")
    names = F.array(*[F.lit(k) for k in KINDS])
    out = found.select("row", "key", "text", F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.concat(F.lit("["), F.upper(F.get(names, s["kind"])), F.lit("]")).alias("form"))).alias("spans"))
    if not terms.isEmpty():
        own = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,form:string>>")), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["form"].alias("form")))
        out = out.join(_term_spans(found, said, terms), F.col("row") == F.col("_row"), "left").withColumn("spans", F.concat("spans", own))
    # From left to right: what a span replaces is not looked at again.
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["form"].alias("form"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))

    def add(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        made = F.when(s["start"] >= acc["at"], F.concat(acc["made"], between, s["form"])).otherwise(acc["made"])
        return F.struct(F.greatest(acc["at"], -s["less"]).alias("at"), made.alias("made"))

    whole = F.aggregate(ordered, start, add, lambda acc: F.concat(acc["made"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return out.select(F.col("key").alias(key), "spans", F.when(F.size("spans") > 0, whole).alias("sanitised"))


def digests(sanitised: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, matches of each kind, the digest of their spans, and all spans."""
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return sanitised.select(key, *counts, F.sha2(spelled(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), spelled("spans").alias("spans"))
