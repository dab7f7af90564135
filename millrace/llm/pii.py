"""Personal data: fixed patterns as seeds, bootstrapped contextual extraction.

DataFrame functions only. The fixed patterns (e-mail, IP address, card, phone)
give every text its base spans. Positions come from the pieces between the
matches, so one linear pass of a possessive pattern finds spans of any number.

The base spans are the seeds of the bootstrap. Candidates are words with a
digit or an ``@``; a candidate's lexical patterns are the one and the two words
before it. Patterns and instances (normalised candidates) form a graph, an edge
counting how often the instance follows the pattern. In each round a pattern's
score for a kind is the share of its occurrences held by instances of that
kind, damped where few distinct seeds support it, and the score of an instance
that is no seed is the mean of its patterns' scores; all sums are aggregates,
so frequent patterns are combined before the shuffle. At the end, occurrences
of high-scoring instances in high-scoring patterns become further spans.

Defined cases: a null text is empty; ids may be null or repeated, every row
gets its own result; a candidate that overlaps a base span is never a find; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")

#: The patterns. Possessive loops match the same texts as greedy
#: ones here and never go back; an e-mail starts where a run of its characters
#: starts, or where the last e-mail ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

SPAN = "array<struct<s: int, k: int, e: int>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(text: Column, pattern: str, item) -> Column:
    """Array of ``item(start, match, text since the match before)`` over all matches.

    Starts are running sums, first within runs of about the root of the number
    of matches, then over the runs, as appending copies an array."""
    gap_and_match = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def add(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["g"])
        return F.struct((s + F.length(x["m"])).alias("at"), F.array_append(a["out"], s).alias("out"))

    def starts(pairs: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(pairs))).cast("int"))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        runs = F.transform(F.sequence(F.lit(1), F.size(pairs), size),
                           lambda i: F.aggregate(F.slice(pairs, i, size), empty, add))

        def shifted(r: Column) -> Column:
            before = F.aggregate(r, empty, lambda a, x: F.struct(
                (a["at"] + x["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
            return F.flatten(F.zip_with(r, before, lambda x, o: F.transform(x["out"], lambda s: s + o)))

        return _let(runs, shifted)

    # the last gap has no match
    pairs = F.filter(gap_and_match, lambda x: x["m"].isNotNull())
    return _let(pairs, lambda p: F.when(F.size(p) > 0, F.zip_with(starts(p), p, lambda s, x: item(s, x["m"], x["g"]))))


def _spans(text: Column, pattern: str, keep, kind: int) -> Column:
    """Spans (s, k, e, m) of the matches m of ``pattern`` for which ``keep(m)``."""
    return F.filter(_places(text, pattern, lambda s, m, g: F.struct(
        s.alias("s"), F.lit(kind).alias("k"), (s + F.length(m)).alias("e"), m.alias("m"))), lambda x: keep(x["m"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(
        r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(a: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + v - F.when(v > 9, 9).otherwise(0)

    size = F.length(d)
    return F.when((size >= 12) & (size <= 19), F.aggregate(
        F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0).otherwise(False)


def _seeds(text: Column) -> Column:
    """All matches of the fixed patterns (s, k, e, m), by start, then kind."""
    none = F.array().cast("array<struct<s: int, k: int, e: int, m: string>>")
    phone_size = lambda m: F.length(_digits(m)).between(9, 15)
    parts = [
        F.when(F.contains(text, F.lit("@")), _spans(text, EMAIL, lambda m: F.lit(True), 0)),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(text, IP, _octets, 1)),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _spans(text, CARD, _luhn, 2)),
        F.when(F.contains(text, F.lit("+")), _spans(text, PHONE, phone_size, 3))]
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start, then kind."""
    return F.transform(_seeds(text), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _candidates(text: Column) -> Column:
    """Candidates: span of the word without outer punctuation, the normalised
    word and the one or two words before it."""
    def item(s: Column, m: Column, g: Column) -> Column:
        head = F.length(F.regexp_extract(m, r"^[^0-9A-Za-z@+]*+", 0))
        core = F.regexp_replace(m, r"^[^0-9A-Za-z@+]++|(?<![^\p{P}\p{S}])[\p{P}\p{S}]++$|[.,;:!?\"')\]}]++$", "")
        # what follows the eighth blank from the end has whole words only
        few = _last_two(F.substring_index(g, " ", -8))
        return F.struct((s + head).alias("s"), (s + head + F.length(core)).alias("e"), ascii_lower(core).alias("i"),
                        F.when(F.size(few) == 2, few).otherwise(_last_two(g)).alias("w"))

    return F.coalesce(F.when(text.rlike("[0-9@]"), _places(text, CANDIDATE, item)),
                      F.array().cast("array<struct<s: int, e: int, i: string, w: array<string>>>"))


def scan_texts(docs: DataFrame) -> DataFrame:
    """_row, doc_id, text_key, base (with the matched texts), cands of every row,
    as a written table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("text_key"),
        _seeds(text).alias("base"), _candidates(text).alias("cands")), "pii-scan")


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row per candidate: its place, instance i, its patterns; if it holds
    the start of a base span, the instance is that span's text and has its kind;
    candidates within a base span are left out. Candidates and spans of a text
    meet by position, in two running aggregates."""
    def of(some: DataFrame) -> DataFrame:
        return some.select("_row", F.explode("cands").alias("c")).select(
            "_row", F.col("c.s").alias("at"), "c.e", "c.i", F.array_compact(F.array(
                F.when(F.size("c.w") >= 1, F.concat(F.element_at("c.w", -1), F.lit(" _"))),
                F.when(F.size("c.w") >= 2, F.concat(F.array_join("c.w", " "), F.lit(" _"))))).alias("patterns"),
            F.lit(None).cast("struct<s: int, k: int, m: string, e: int>").alias("b")).filter("e > at")

    spans = rows.select("_row", F.explode("base").alias("x")).select(
        "_row", F.col("x.s").alias("at"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("string").alias("i"),
        F.lit(None).cast("array<string>").alias("patterns"), F.struct("x.s", "x.k", "x.m", "x.e").alias("b"))
    text = Window.partitionBy("_row")
    before = text.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    onward = text.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = (of(rows.filter(F.size("base") > 0)).unionByName(spans)
           .withColumn("reach", F.max("b.e").over(before)).withColumn("next", F.min("b").over(onward))
           .filter((F.col("e").isNotNull()) & (F.coalesce("reach", F.lit(0)) <= F.col("at")))
           .withColumn("seed", F.when(F.col("next.s") < F.col("e"), F.col("next"))))
    met = met.select("_row", F.col("at").alias("s"), "e", F.coalesce(ascii_lower(F.col("seed.m")), "i").alias("i"),
                     F.col("seed.k").alias("kind"), "patterns")
    alone = of(rows.filter(F.size("base") == 0)).select(
        "_row", F.col("at").alias("s"), "e", "i", F.lit(None).cast("int").alias("kind"), "patterns")
    return met.unionByName(alone)


def _last_two(before: Column) -> Column:
    """The last two words of a text, in order, or fewer if it has fewer."""
    words = F.filter(F.split(ascii_lower(before), r"[\s\p{P}\p{S}]+"), lambda w: w != "")
    return _let(words, lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), F.lit(2)))


def bootstrap(rows: DataFrame, rounds: int = 3, least_seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """(_row, found): spans that high-confidence patterns add."""
    occ = materialize(_occurrences(rows).select("*", F.explode("patterns").alias("p")).drop("patterns"), "pii-occurrences")
    edges = materialize(occ.groupBy("p", "i").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "pii-edges")
    kinds = range(len(KINDS))
    seeds = edges.groupBy("i").agg(F.max("kind").alias("kind"))
    scores = seeds.select("i", "kind", *[F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"s{k}") for k in kinds])
    scores = materialize(scores, "pii-instances")
    for _ in range(rounds):
        patterns = edges.drop("kind").join(scores, "i").groupBy("p").agg(
            F.count("kind").alias("seeds"), *[(F.sum(F.col("n") * F.col(f"s{k}")) / F.sum("n")).alias(f"_{k}") for k in kinds])
        damp = F.least(F.lit(1.0), F.col("seeds") / least_seeds)
        patterns = materialize(patterns.select("p", "seeds", *[(F.col(f"_{k}") * damp).alias(f"p{k}") for k in kinds]), "pii-patterns")
        told = edges.select("p", "i", "n").join(patterns, "p").groupBy("i").agg(
            *[(F.sum(F.col("n") * F.col(f"p{k}")) / F.sum("n")).alias(f"t{k}") for k in kinds])
        scores = materialize(scores.join(told, "i").select("i", "kind", *[
            F.when(F.col("kind").isNull(), F.col(f"t{k}")).otherwise(F.col(f"s{k}")).alias(f"s{k}") for k in kinds]), "pii-instances")
    good = patterns.filter((F.col("seeds") >= least_seeds) & (F.greatest(*[F.col(f"p{k}") for k in kinds]) >= sure))
    new = scores.filter(F.col("kind").isNull() & (F.greatest(*[F.col(f"s{k}") for k in kinds]) >= sure))
    best = F.array_position(F.array(*[F.col(f"s{k}") for k in kinds]), F.greatest(*[F.col(f"s{k}") for k in kinds])) - 1
    new = small_side(materialize(new.select("i", best.cast("int").alias("k")), "pii-new"))
    return (occ.filter("kind IS NULL").join(new, "i").join(small_side(materialize(good.select("p"), "pii-good")), "p", "left_semi")
            .groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("s", "k", "e"))).alias("found")))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def extract(docs: DataFrame, rounds: int = 3, least_seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """doc_id, text_key, base and found (arrays of spans s, k, e) of every row."""
    rows = scan_texts(docs)
    found = small_side(materialize(bootstrap(rows, rounds, least_seeds, sure), "pii-found"))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base")
    return rows.select("_row", "doc_id", "text_key", base).join(found, "_row", "left").select(
        "doc_id", "text_key", "base", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def digest(extracted: DataFrame) -> DataFrame:
    """The contract's columns from the spans."""
    many = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return extracted.select(
        "doc_id", *[many(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; a span that
    starts within the one before it is covered by that one's mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.array_append(F.array_append(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"])),
                             F.element_at(names, x["k"] + 1))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, first, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked, other columns as they are."""
    got = extract(docs).filter(F.size("found") > 0).groupBy(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.first("found").alias("_found"))
    found = small_side(materialize(got, "pii-masks"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_k"]), "left")
    spans = F.array_sort(F.concat(base_spans(docs["text"]), F.coalesce(found["_found"], F.array().cast(SPAN))))
    new = F.when(docs["text"].isNotNull(), masked(docs["text"], spans))
    return joined.select(*[new.alias(c) if c == "text" else docs[c] for c in docs.columns])
