"""Personal data, and terms of the text around it that give it away.

Base spans come from four patterns. The method then treats every distinct value found as a protected
entity and asks of each term in its texts how much of the entity's information it discloses over the
corpus: pointwise mutual information of term and entity, divided by the entity's own information. Counts
are numbers of distinct whole texts, so exact copies are no evidence. Terms that at least ``support``
texts hold together with the entity are generalised from one threshold on and removed from a higher one on.

Everything is DataFrame expressions. A text is read once for the base spans and once for the document
counts of all terms; only texts with a base span are kept in between. Entities of fewer than
``support`` texts can't reach it with any term, so their texts make no pairs.

Null text counts as empty; repeated rows are scanned each for itself; null ids and extra columns are
harmless (doc_id and text are read); an empty table gives no rows. Very long texts take time in proportion
to their length: patterns start at the first character of a run only, and matches are placed in blocks.
Ties don't matter: a term gets the stronger of the actions that the entities of its text ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_BYTES, sized, stash

KINDS = ("email", "ip", "card", "phone")
#: Possessive where no backtracking can help, so that long runs neither take long nor nest deep. A match that fails from a
#: run's first character fails from all others of the run, so it begins there or where the last match ended (\\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for: cheap, and never missing where a valid match is.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Stand before and after matches, and for that character where a text has it itself; no pattern matches either.
MARK, OTHER = "\x01", "\x02"
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: Parts of a text, every other one a match, that are placed at once.
PLACED = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def found(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches with start and end in code points."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, F.lit(f"{MARK}$0{MARK}") if isinstance(pattern, Column) else f"{MARK}$0{MARK}")

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def placed(parts: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(parts, start, step, lambda acc: acc["spans"])

    def begins(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part)))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    # arrays grow by copying, so many matches are placed a block at a time; blocks are even, and begin outside a match
    cut = lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(PLACED)).cast("int")), lambda b: F.slice(parts, b * PLACED + 1, F.lit(PLACED)))
    many = lambda parts: let(cut(parts), lambda blocks: F.flatten(F.zip_with(blocks, F.slice(begins(blocks), F.lit(1), F.size(blocks)), placed)))
    return let(F.split(marked, MARK), lambda parts: F.when(F.size(parts) <= PLACED, placed(parts, F.lit(0))).otherwise(many(parts)))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), digit + 1)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)){3}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(SPAN)
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, F.filter(found(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))).otherwise(none)


def terms_of(text: str) -> Column:
    """Distinct lower-cased terms of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def disclosing(hits: DataFrame, docs: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """of, term, action: for each of the distinct texts hits (of, text, entities), the terms that disclose one of its entities over the corpus."""
    entities = hits.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("alone")).where(F.col("alone") >= support)
    entities = stash(entities, "entities")
    of = F.xxhash64(F.coalesce("text", F.lit(""))).alias("of")
    copies = stash(docs.select(of).groupBy("of").agg(F.count("*").alias("copies")), "copies")
    n = float(copies.count())

    def score(texts: str) -> Column:
        pmi = F.log(F.lit(n) * F.col("both") / (F.col("alone") * F.col(texts))) / F.log(F.lit(n) / F.col("alone"))
        # an entity of every text has no information to give away
        return F.when(F.col("alone") < F.lit(n), pmi).otherwise(F.lit(0.0))

    # texts are distinct, and so are entities and terms within one: no pair counts twice
    named = hits.select("of", F.explode("entities").alias("entity")).join(sized(entities.select("entity")), "entity")
    named = stash(named.select("of", "entity"), "named")
    # outer, as Spark would else evaluate the terms twice, the second time in a filter
    held = hits.join(named, "of", "left_semi").select("of", F.explode_outer(terms_of("text")).alias("term")).where("term is not null")
    held = stash(held, "held")
    together = held.join(named, "of").groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    # texts of any entity with the term are some of those with it, so this leaves out no term that discloses
    at_least = hits.select(F.explode_outer(terms_of("text")).alias("term")).groupBy("term").agg(F.count("*").alias("near_texts"))
    together = together.join(sized(entities), "entity").join(at_least, "term").where(score("near_texts") >= generalise)
    together = stash(together, "together")
    # every document of the corpus counts for a term; those that have copies once each, all others without telling them apart
    again = stash(copies.where("copies > 1").select("of", F.lit(True).alias("again")), "again")
    words = docs.select(F.coalesce("text", F.lit("")).alias("text"), of).join(sized(again, 4 * BROADCAST_BYTES), "of", "left")
    words = words.select(F.when(F.col("again"), F.col("of")).alias("of"), F.explode_outer(terms_of("text")).alias("term")).where("term is not null")
    in_texts = words.groupBy("term", "of").agg(F.count("*").alias("texts"))
    in_texts = in_texts.groupBy("term").agg(F.sum(F.when(F.col("of").isNull(), F.col("texts")).otherwise(F.lit(1))).alias("texts"))
    scored = together.join(in_texts, "term").withColumn("score", score("texts")).where(F.col("score") >= generalise)
    told = stash(scored.select("entity", "term", F.when(F.col("score") >= remove, "remove").otherwise("generalise").alias("action")), "disclosing")
    met = held.join(sized(told), "term").join(named, ["of", "entity"])
    # the strongest action that any entity of the text asks for
    return met.groupBy("of", "term").agg(F.max("action").alias("action"))


def scan(docs: DataFrame, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """doc_id, text, spans (kind, start, end, value) of each row of docs (doc_id, text), in the order of kinds, then start.

    Base kinds are those of PATTERNS. Kinds ``generalise`` and ``remove`` are terms within the same text as an
    entity that they disclose. ``text`` is kept for rows with a span, null elsewhere.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *[base_spans(text, k).alias(k) for k in KINDS])
    rows = rows.withColumn("hits", sum((F.size(k) for k in KINDS), F.lit(0)))
    rows = rows.withColumn("of", F.when(F.col("hits") > 0, F.xxhash64("text"))).withColumn("text", F.when(F.col("hits") > 0, F.col("text")))
    rows = stash(rows, "pii")
    entity = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), F.lower(s["value"])))
    hits = rows.where("hits > 0").select("of", "text", F.array_distinct(F.concat(*[entity(k) for k in KINDS])).alias("entities")).dropDuplicates(["of"])
    told = disclosing(stash(hits, "hits"), docs, support, generalise, remove)
    told = stash(told.groupBy(F.col("of").alias("told_of")).agg(F.collect_list(F.struct("term", "action")).alias("terms")), "told")
    rows = rows.join(told, F.col("of") == F.col("told_of"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms.term", "|"), F.lit(r")(?!\p{L})"))
    acted = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["action"])))
    extra = F.transform(found(F.col("text"), pattern), lambda s: F.struct(F.coalesce(F.element_at(acted, F.lower(s["value"])), F.lit("generalise")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    extra = F.when(F.col("terms").isNotNull(), extra).otherwise(none)
    # terms inside base spans are part of those
    base = F.concat(*[named(k) for k in KINDS])
    rows = rows.withColumn("base", base).withColumn("extra", extra)
    free = F.filter("extra", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    free = F.array_sort(free, lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return rows.select("doc_id", "text", "base", F.concat("base", free).alias("spans"))


def listed(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(scanned: DataFrame) -> DataFrame:
    """doc_id and clean_text of scan()'s rows: values by their kind, generalised terms by TERM, removed ones by nothing; null where nothing was found."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        grown = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), label)
        over = s["start"] < acc["at"]
        return F.struct(F.when(over, acc["out"]).otherwise(grown).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return scanned.select("doc_id", F.aggregate(order, start, step, rest).alias("clean_text"))
