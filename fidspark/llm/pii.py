"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities (e-mail, IP, card, phone). Beyond them,
words can give an entity away: over the distinct contexts of the corpus, a word
t discloses PMI(c; t) of an entity's information IC(c) = -log2 p(c), with PMI =
log2(p(c, t) / (p(c) p(t))). A context is a line with the NEAR lines before and
after it that are not blank; all counts are of contexts. A word that discloses
at least GENERALISE of IC(c) is generalised, one that discloses REMOVE of it is
removed, wherever it stands in a document that holds c. Words need SUPPORT
distinct contexts around lines with the entity, or distinct contexts with it in
SUPPORT documents: a copied context is no evidence.

All of it is columns, joins and aggregates. Spans count code points, end
exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidspark.llm.common import let, stage, text_of, words_of

GENERALISE, REMOVE, SUPPORT, NEAR = 0.75, 0.9, 2, 1
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"

# Possessive forms of the contract's patterns. A match that could start inside a run of its first class would also start
# at the run's start or right after the last match (\G), so other starts need not be tried: long runs stay linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY_HOLD = r"@|[0-9][ ().-]*[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + doubled
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind: the gaps that split() leaves between matches give their places."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)

    def place(gaps_and_matches: Column) -> Column:
        gaps, matches = gaps_and_matches["g"], gaps_and_matches["m"]
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(acc: Column, i: Column) -> Column:
            m = F.get(matches, i)
            lo = acc["at"] + F.length(F.get(gaps, i))
            span = F.struct(lo.alias("start"), F.lit(rank).alias("rank"), (lo + F.length(m)).alias("stop"), F.lit(kind).alias("kind"), m.alias("value"))
            return F.struct((lo + F.length(m)).alias("at"), F.when(_valid(kind, m), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step)["spans"]

    empty = F.array().cast(_SPAN)
    found = let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
                lambda x: F.when(F.size(x["m"]) == 0, empty).otherwise(place(x)))
    may = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9][ .-]?[0-9]")
    return F.when(may, found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by start, then kind as listed."""
    return F.array_sort(F.concat(*(_kind_spans(text, k) for k in PATTERNS)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))))


def _term(word: Column) -> Column:
    """A word in lower case without punctuation around it; empty if it has neither letters nor digits."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _outside(line: Column) -> Column:
    """The words of a line that no base span touches: spans become a mark first."""
    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(line, acc["at"] + 1, s["start"] - acc["at"]), F.lit("\0"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    marked = F.aggregate(base_spans(line), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda acc: F.concat(acc["out"], F.substring(line, acc["at"] + 1, F.length(line))))
    return F.filter(words_of(marked), lambda w: ~w.contains("\0"))


def _terms(line: Column) -> Column:
    words = F.when(line.rlike(_MAY_HOLD), _outside(line)).otherwise(words_of(line))
    return F.array_remove(F.array_distinct(F.transform(words, _term)), "")


def _around(lines: Column, i: Column, near: int) -> Column:
    lo = F.greatest(i - near, F.lit(0))
    return F.slice(lines, lo + 1, i + near + 1 - lo)


def _contexts(docs: DataFrame, near: int, *what: tuple[str, Callable[[Column], Column]], joined: DataFrame | None = None) -> DataFrame:
    """(_rid, i, unit, a column for each of ``what``, those of ``joined`` by _rid): the contexts of all texts; each line is taken apart once."""
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), text_of().alias("_t"))
    rows = rows if joined is None else rows.join(joined, "_rid")
    extra = [] if joined is None else [c for c in joined.columns if c != "_rid"]

    def units(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x["lines"]) - 1)
        found = F.transform(at, lambda i: F.struct(
            i.alias("i"), F.xxhash64(_around(x["lines"], i, near), F.least(i, F.lit(near))).alias("unit"),
            *(F.array_distinct(F.flatten(_around(x[name], i, near))).alias(name) for name, _ in what),
            *(F.get(x[name], i).alias(f"own_{name}") for name, _ in what if name == "entities")))
        return F.when(F.size(x["lines"]) > 0, found)

    of_lines = lambda lines: F.struct(lines.alias("lines"), *(F.transform(lines, f).alias(name) for name, f in what))
    found = let(_lines(F.col("_t")), lambda lines: let(of_lines(lines), units))
    return rows.select("_rid", *extra, F.explode(found).alias("c")).select("_rid", *extra, "c.*")


def _entities(line: Column) -> Column:
    return F.when(line.rlike(_MAY_HOLD), F.array_distinct(F.transform(base_spans(line), _entity))).otherwise(F.array().cast("array<string>"))


def _marked(entities: Column, own: Column) -> Column:
    """The entities of a context with ``centre`` 1 if its own line holds them, else 0."""
    mark = lambda which, centre: F.transform(which, lambda e: F.struct(e.alias("entity"), F.lit(centre).cast("long").alias("centre")))
    return F.concat(mark(own, 1), mark(F.array_except(entities, own), 0))


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT,
                     near: int = NEAR) -> DataFrame:
    """(entity, term, kind): words that disclose an entity, with "generalised" or "removed"."""
    holding = docs.select("text").filter(text_of().rlike(_MAY_HOLD))
    held = _contexts(holding, near, ("entities", _entities), ("terms", _terms)).filter(F.size("entities") > 0)
    # equal contexts, of copies, fall together
    held = held.groupBy("unit").agg(F.min("_rid").alias("_rid"), F.first(F.struct("entities", "own_entities", "terms")).alias("c"))
    held = stage(held.select("unit", "_rid", "c.terms", _marked(F.col("c.entities"), F.col("c.own_entities")).alias("marked")), "contexts")

    def counted_by(df: DataFrame, *keys: str) -> DataFrame:
        """Contexts of each key, if enough of them are around the entity's own lines or in different documents."""
        by_doc = df.groupBy(*keys, "_rid").agg(F.count("*").alias("n"), F.sum("centre").alias("centre"))
        found = by_doc.groupBy(*keys).agg(F.sum("n").alias("n"), F.greatest(F.sum("centre"), F.count("*")).alias("support"))
        return found.filter(F.col("support") >= support).drop("support")

    # only entities with support meet the words of their contexts, which are stored once per context
    each = held.select("unit", "_rid", F.explode("marked").alias("m")).select("unit", "_rid", "m.*")
    n_entity = stage(counted_by(each, "entity").withColumnRenamed("n", "n_entity"), "entities")
    kept = each.join(n_entity, "entity", "left_semi").groupBy("unit").agg(F.collect_list(F.struct("entity", "centre")).alias("kept"))
    met = held.select("unit", "_rid", "terms").join(kept, "unit").select("_rid", "terms", F.explode("kept").alias("m"))
    pairs = counted_by(met.select("_rid", "m.*", F.explode("terms").alias("term")), "entity", "term").withColumnRenamed("n", "n_both")
    pairs = stage(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit("").alias("kind"))
    # of equal contexts the first is counted; only their keys are shuffled
    first = stage(_contexts(docs, near).groupBy("unit").agg(F.min(F.struct("_rid", "i")).alias("f")).select("f.*"), "units")
    n = max(1, first.count())
    at = first.groupBy("_rid").agg(F.collect_list("i").alias("at"))
    counted = _contexts(docs, near, ("terms", _terms), joined=at).filter(F.array_contains("at", F.col("i")))
    lines = stage(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    ic = F.log2(F.lit(float(n)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * float(n) / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    weighed = pairs.join(n_entity, "entity").join(lines, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))
    return weighed.filter(F.col("share") >= generalise).select(
        "entity", "term", F.when(F.col("share") >= remove, "removed").otherwise("generalised").alias("kind"))


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per input row: _rid, doc_id, base (array of spans) and spans (base and those of the method), both in order.

    A null text is empty; an empty text has no spans; a text of any length is
    read whole, line by line; repeated rows get equal spans; overlapping spans of different kinds all stay. An empty table gives
    an empty table; columns other than doc_id and text are not looked at. The
    input is read several times and must give the same rows in the same order
    (files, or a staged table).
    """
    heads = stage(docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", base_spans(text_of()).alias("base")), "spans")
    terms = stage(disclosing_terms(docs, **thresholds), "disclosing")
    if terms.isEmpty():
        return heads.withColumn("spans", F.col("base"))
    held = heads.select("_rid", F.explode("base").alias("s")).select("_rid", _entity(F.col("s")).alias("entity")).distinct()
    risky = held.join(terms, "entity").groupBy("_rid", "term").agg(F.max("kind").alias("kind"))
    # words of the documents concerned with their places: a running sum along each document
    texts = docs.select(F.monotonically_increasing_id().alias("_rid"), text_of().alias("_t")).join(risky.select("_rid").distinct(), "_rid", "left_semi")
    word = r"[^\x20\x09-\x0D]+"
    parts = texts.select("_rid", F.split("_t", word, -1).alias("g"), F.regexp_extract_all("_t", F.lit(word), F.lit(0)).alias("m"))
    words = parts.select("_rid", "g", F.posexplode("m").alias("i", "w")).select("_rid", "i", "w", F.length(F.get("g", F.col("i"))).alias("gap"))
    along = Window.partitionBy("_rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("stop", F.sum(F.col("gap") + F.length("w")).over(along)).withColumn("term", _term(F.col("w"))).filter("term <> ''")
    lead = F.length("w") - F.length(F.regexp_replace("w", r"^[^\p{L}\p{N}]+", ""))
    lo = (F.col("stop") - F.length("w") + lead).cast("int")
    span = F.struct(lo.alias("start"), F.when(F.col("kind") == "removed", 5).otherwise(4).alias("rank"), (lo + F.length("term")).alias("stop"),
                    F.col("kind"), F.col("term").alias("value"))
    # what a base span touches is masked with it or beside it
    free = ~F.exists("base", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("stop") - F.length("w")))
    words = words.join(risky, ["_rid", "term"]).join(heads.select("_rid", "base"), "_rid").filter(free)
    more = words.groupBy("_rid").agg(F.collect_list(span).alias("more"))
    return heads.join(more, "_rid", "left").select("_rid", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", F.col("more").cast(_SPAN)))).alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their masks (of overlapping spans the first); same columns."""
    found = find(docs, **thresholds).filter(F.size("spans") > 0).select("_rid", "spans")
    packed = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("_row"), text_of().alias("_t"))
    mask = F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]), mask[s["kind"]])
        new = F.struct(s["stop"].alias("at"), piece.alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    out = packed.join(found, "_rid", "left").withColumn("_clean", F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(done))
    return out.select("_row.*", "_clean").withColumn("text", F.col("_clean")).drop("_clean").select(*docs.columns)
