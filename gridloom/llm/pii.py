"""Personal data: patterns for base entities, and terms that disclose them by corpus co-occurrence.

Base entities are e-mail addresses, IP addresses, card and phone numbers; what is protected is each of
them and the group it belongs to (mail domain, /24 network, issuer, dialling prefix). A term of the same
text may give one away. How strongly is estimated from the whole corpus: with df the number of
documents, the pointwise mutual information of entity e and term t over the information of e is

    disclosure(e, t) = log2(df(e, t) * N / (df(e) * df(t))) / log2(N / df(e)),

1 if t occurs in no document without e. With ``distinct``, as the query has it, rows of the very same text are one
document in all of these counts, since a copy is no further evidence; a text that differs anywhere counts by
itself. Without, each row is a document. Evidence must outweigh the search for it: among the V terms of two
documents or more, some meet e in all of n documents by chance unless n * log2(N / df(e)) > log2(V), so that
many shared documents are asked for, anywhere in their texts, and two at least (one estimates nothing). A term at or
over ``THRESHOLD`` is generalised to its class (number, word, mixed), or removed where the class
discloses an entity as well, at every place of every text.

Everything is DataFrame functions: no Python runs on the executors. Columns of the caller's may have any
names: own ones get names that no column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, materialise, release, text_or_empty

#: Documents that an entity and a term must share at least.
MIN_SUPPORT = 2
THRESHOLD = 0.9
#: Common terms, at most, whose counts are broadcast to leave out pairs that cannot disclose.
COMMON_TERMS = 100_000
#: Row numbers, at most, that are broadcast (8 bytes each) to pick texts (with an entity, with a flagged term, not repeated) before any is shuffled.
BROADCAST_ROWS = 2_000_000

#: Kinds in the order of the report; possessive quantifiers keep long runs linear, and a look-behind
#: starts a match only at a run's first character or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a digit string is a multiple of ten."""
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.split(found, r"\.")
        number = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(parts, lambda x: (F.length(number(x)) <= 3) & (F.coalesce(F.when(F.length(number(x)) <= 3, number(x)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(found)).between(12, 19) & luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, kind, stop, value>> of a kind's valid matches, in code points.

    The text between matches gives their places: each match starts behind all that precedes it.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast(SPANS)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        stop = at + F.length(pair["found"])
        item = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), pair["found"].alias("value"))
        return F.struct(stop.alias("at"), F.when(F.coalesce(valid(kind, pair["found"]), F.lit(False)), F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    return F.when(F.size(gaps) > 1, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``pii_text`` and ``pii_base``: the base entities by start, then kind."""
    src = docs.select(*keep, text_or_empty(F.col("text")).alias("pii_text"))
    text = F.col("pii_text")
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(PATTERNS["card"]), "phone": text.contains("+")}
    none = F.array().cast(SPANS)
    each = [F.when(may[k], matches(text, k)).otherwise(none) for k in PATTERNS]
    return src.withColumn("pii_base", F.array_sort(F.concat(*each)))


#: A term is a run of letters and digits.
TERM = r"[\p{L}\p{N}]++"
#: Stands for the characters of base entities; a term that touches one is part of it.
MASK = "\uffff"
CLEAR_TERM = rf"(?<![\p{{L}}\p{{N}}{MASK}]){TERM}(?!{MASK})"
def term_class(term: Column) -> Column:
    return F.when(term.rlike(r"^[0-9]+$"), "number").when(term.rlike(r"[0-9]"), "mixed").otherwise("word")


def terms(text: Column, pattern: str = TERM) -> Column:
    """A text's distinct terms in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def with_classes(found: Column) -> Column:
    """A text's terms and, marked by a character that no term has, the classes that they generalise to."""
    return F.concat(found, F.array_distinct(F.transform(found, lambda t: F.concat(F.lit(MASK), term_class(t)))))


def masked(text: Column, base: Column) -> Column:
    """The text with the characters of base entities masked; places stay."""

    def step(acc: Column, b: Column) -> Column:
        first = F.greatest(acc["at"], b["start"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, first - acc["at"]), F.repeat(F.lit(MASK), F.greatest(b["stop"] - first, F.lit(0))))
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), more.alias("out"))

    return F.aggregate(base, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def texts(docs: DataFrame) -> DataFrame:
    """(pii_row, pii_text); the row number is that of the scan."""
    return docs.select(F.monotonically_increasing_id().alias("pii_row"), text_or_empty(F.col("text")).alias("pii_text"))


def copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(pii_row) of the rows whose text stands in a row before, written, and the number of distinct texts.

    Only digests are shuffled. A text of very many rows is a hot key of the join, whose sides are
    written tables that adaptive execution can split.
    """
    digest = F.unhex(F.md5(F.col("pii_text").cast("binary"))).alias("digest")
    rows = materialise(texts(docs).select("pii_row", digest), "digests")
    first = materialise(rows.groupBy("digest").agg(F.min("pii_row").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    more = rows.join(first.where("n > 1"), "digest").where("pii_row <> first").select("pii_row")
    more, distinct = materialise(more, "copies"), first.count()
    release(rows, first)
    return more, distinct


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose pii_row is not among ``others``; not shuffled while these are few."""
    return rows.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, "pii_row", "left_anti")


def located(docs: DataFrame) -> DataFrame:
    """pii_row, doc_id and pii_base per row; the row number is that of the scan."""
    named = docs.select(F.monotonically_increasing_id().alias("pii_row"), "doc_id", "text")
    return base_spans(named, ["pii_row", "doc_id"]).select("pii_row", "doc_id", "pii_base")


def group_of(kind: Column, value: Column) -> Column:
    """The group of a base entity: mail domain, /24 network, card issuer (6 digits), phone number without its last 4 digits."""
    numbers = digits(value)
    prefix = F.concat(F.lit("+"), F.substring(numbers, F.lit(1), F.length(numbers) - 4))
    of = [F.lower(F.regexp_extract(value, "@.*$", 0)), F.regexp_extract(value, r"^(?:[0-9]+\.){3}", 0), F.substring(numbers, 1, 6), prefix]
    return F.get(F.array(*of), kind)


def entities(found: DataFrame) -> DataFrame:
    """(pii_row, kind, value) distinct: each text's base entities and, of kind + 4, their groups; ``found`` is located()."""
    each = F.explode(F.array_distinct(F.transform("pii_base", lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("pii_value")))))
    one = found.select("pii_row", each.alias("e")).select("pii_row", "e.kind", "e.pii_value")
    groups = one.select("pii_row", (F.col("kind") + len(PATTERNS)).alias("kind"), group_of(F.col("kind"), F.col("pii_value")).alias("value")).distinct()
    return one.select("pii_row", "kind", F.col("pii_value").alias("value")).unionByName(groups)


def disclosing(docs: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD, distinct: bool = False) -> DataFrame:
    """(kind, value, term, replacement): terms that disclose an entity; ``found`` is located(), written.

    The replacement is the term's class in angle brackets, or empty where the class discloses too. Classes
    are counted like terms, in the same pass. Of entities of the same documents the least is named.
    ``distinct``: rows of the same text are one document.
    """
    repeats, n_docs = copies(docs) if distinct else (None, docs.count())
    once = (lambda rows: without(rows, repeats)) if distinct else (lambda rows: rows)
    total = float(max(n_docs, 1))
    every = materialise(entities(once(found)), "entities")
    # Entities of the very same documents (told by count and two sums of hashes) disclose alike: one stands for all.
    sums = [F.sum(F.xxhash64("pii_row").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("pii_row", F.lit(1))).alias("x")]
    known = every.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("entity_docs"), *sums).where(F.col("entity_docs") >= min_support)
    known = known.groupBy("entity_docs", "s", "x").agg(F.min(F.struct("kind", "value")).alias("e")).select("e.*", "entity_docs")
    known = materialise(known.withColumn("entity", F.monotonically_increasing_id()), "known")  # numbers, so that pairs stay short
    held = materialise(every.join(known, ["kind", "value"]).select("pii_row", "entity", "entity_docs"), "holders")
    counted = once(texts(docs)).select(F.explode(with_classes(terms(F.col("pii_text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    term_docs = materialise(counted.where(F.col("term_docs") >= min_support), "terms")
    is_class = F.col("term").startswith(MASK)

    # Sizes by powers of two: a small table from which the cut between common and other terms is read.
    sizes = sorted(((r["size"], r["n"]) for r in term_docs.where(~is_class).groupBy(F.length(F.bin("term_docs")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    searched, cut, so_far = sum(n for _, n in sizes), 1 << 62, 0
    for size, n in sizes:
        so_far += n
        if so_far > COMMON_TERMS:
            break
        cut = 1 << (size - 1)
    common = term_docs.where(~is_class & (F.col("term_docs") >= cut)).select("term", F.col("term_docs").alias("common_docs"))

    holders = found.join(held.select("pii_row").distinct(), "pii_row", "left_semi").select("pii_row", "pii_base")
    rows, ids = texts(docs), materialise(held.select("pii_row").distinct(), "holding")
    if ids.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), "pii_row", "left_semi")  # else all texts would be shuffled
    beside = rows.join(holders, "pii_row").select("pii_row", with_classes(terms(masked(F.col("pii_text"), F.col("pii_base")), CLEAR_TERM)).alias("terms"))
    beside = materialise(beside, "beside")
    met = beside.join(held, "pii_row").select("entity", "entity_docs", F.explode("terms").alias("term"))
    # A term of more documents than this reaches the threshold with no entity of so few, even if it is in all of them.
    most = F.pow("entity_docs", F.lit(threshold)) * total ** (1 - threshold) * (1 + 1e-9)
    able = met.join(F.broadcast(common), "term", "left").where(F.col("common_docs").isNull() | (F.col("common_docs") <= most))
    both = able.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_support)
    both = materialise(both.join(known, "entity"), "pairs")

    information = F.log2(F.lit(total) / F.col("entity_docs"))
    mutual = F.log2(F.col("both") * F.lit(total) / (F.col("entity_docs") * F.col("term_docs")))
    evident = both.where(is_class | (F.col("both") * information > F.log2(F.lit(float(max(searched, 1)))))).join(term_docs, "term")
    pair = ["kind", "value", "term"]
    strong = materialise(evident.where(F.when(information > 0, mutual / information).otherwise(0.0) >= threshold).select(*pair), "strong")
    release(*[repeats] * distinct, every, known, held, ids, beside, both, term_docs)
    general = strong.where(is_class).select("kind", "value", F.substring("term", 2, 100).alias("class"), F.lit(True).alias("general"))
    judged = strong.where(~is_class).withColumn("class", term_class(F.col("term"))).join(general, ["kind", "value", "class"], "left")
    return judged.select(*pair, F.when(F.col("general"), "").otherwise(F.concat(F.lit("<"), F.col("class"), F.lit(">"))).alias("replacement"))


def term_spans(docs: DataFrame, found: DataFrame, distinct: bool = False) -> DataFrame:
    """(pii_row, pii_terms array<struct<start, kind, stop, value>>): disclosing terms; value is the replacement.

    Every occurrence in every text but inside base entities. Texts that hold a flagged term are searched
    for the forms in which it stands in them; the others are read once, and not shuffled while the former are few.
    """
    flagged = materialise(disclosing(docs, found, distinct=distinct).groupBy("term").agg(F.min("replacement").alias("value")), "flagged")
    rows = texts(docs)
    forms = F.array_distinct(F.regexp_extract_all("pii_text", F.lit(TERM), F.lit(0)))
    held = rows.select("pii_row", F.explode(forms).alias("form")).withColumn("term", F.lower("form")).join(flagged, "term")
    held = held.groupBy("pii_row").agg(F.sort_array(F.collect_list(F.struct("form", "value"))).alias("forms"))
    held = materialise(held.withColumn("forms", F.map_from_entries("forms")), "forms")
    if held.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(held.select("pii_row")), "pii_row", "left_semi")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("forms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    marked = rows.join(held, "pii_row").withColumn("pattern", pattern)
    gaps, runs = F.split("pii_text", F.col("pattern"), -1), F.regexp_extract_all("pii_text", F.col("pattern"), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(runs)), runs, lambda g, f: F.struct(g.alias("gap"), f.alias("form")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["gap"])
        stop = at + F.length(p["form"])
        item = F.struct(at.alias("start"), F.lit(KINDS.index("term")).alias("kind"), stop.alias("stop"), F.element_at("forms", p["form"]).alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    spans = marked.select("pii_row", F.aggregate(pairs, start, step, lambda acc: acc["out"]).alias("pii_terms")).join(found.select("pii_row", "pii_base"), "pii_row", "left")
    clear = F.filter("pii_terms", lambda t: ~F.exists(F.coalesce("pii_base", F.array().cast(SPANS)), lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    out = materialise(spans.select("pii_row", clear.alias("pii_terms")).where(F.size("pii_terms") > 0), "term_spans")
    release(flagged, held)
    return out


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Null text is empty and has no spans. Rows that repeat an id, or are equal, are reported each; with
    ``distinct`` rows of the same text are one document as evidence.
    """
    found = materialise(located(docs), "located")
    terms = term_spans(docs, found, distinct)
    rows = found.select("pii_row", "doc_id", "pii_base").join(terms, "pii_row", "left")
    none = F.array().cast(SPANS)
    count = lambda k: F.size(F.filter("pii_base", lambda b: b["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.concat("pii_base", F.coalesce("pii_terms", none))
    return rows.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(written(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: entities by <kind>, terms generalised or removed.

    Documents that hold an entity are shuffled; of the others those with a disclosing term are few
    and the rest keep their text as it is. A null text stays null, an empty table stays empty; rows that
    repeat an id or are equal are treated each. All other columns keep their names and values, whatever
    they are called; only ``n_chars``, where there is one, follows the new text.
    """
    columns = docs.columns
    row, cuts_col = fresh("pii_row", columns), fresh("pii_cuts", columns)
    found = materialise(located(docs).where(F.size("pii_base") > 0), "located")
    terms = term_spans(docs, found)
    none = F.array().cast(SPANS)
    names = F.array(*[F.lit(f"<{k}>") for k in PATTERNS])
    entities = F.transform("pii_base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop"), F.get(names, b["kind"]).alias("value")))
    every = found.select("pii_row", "pii_base").join(terms, "pii_row", "full")
    cuts = every.select(F.col("pii_row").alias(row), F.array_sort(F.concat(F.coalesce(entities, none), F.coalesce("pii_terms", none))).alias(cuts_col), F.col("pii_base").isNull().alias("pii_only_terms"))
    cuts = materialise(cuts, "cuts")
    release(found, terms)

    text = F.col("text").cast("string")
    may = F.coalesce(text.rlike("|".join(f"(?:{p})" for p in PATTERNS.values())), F.lit(False))
    rows = docs.withColumn(row, F.monotonically_increasing_id())

    def step(acc: Column, c: Column) -> Column:
        kept = F.when(c["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["value"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["stop"]).alias("at"), kept.alias("out"))

    clean = F.aggregate(F.col(cuts_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    all_cuts, few = cuts.select(row, cuts_col), cuts.where("pii_only_terms").select(row, cuts_col)
    changed = rows.where(may).join(all_cuts, row, "left").unionByName(rows.where(~may).join(few, row))
    changed = changed.withColumn("text", F.when(F.col(cuts_col).isNull(), text).otherwise(clean))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    own = [F.col(f"`{c}`") for c in columns]
    return rows.where(~may).join(few.select(row), row, "left_anti").select(*own).unionByName(changed.select(*own))
