"""Query understanding as a batch job: a table of query texts in, a table of filters out.

Each step takes its match out of the text before the next one looks: people, places, kinds of image, one date phrase,
filler. Known names reach a query through an equi-join on their first word, never by pairing all names with
all queries; the order-dependent removal is a fold over the few names that survive.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.dates import date_phrase, remove_first, strip_dates
from ..session import cut_lineage

_NO_NAMES = "array<string>"


def _literal(name: Column) -> Column:
    """A regex that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def name_pattern(name: Column, possessive: bool) -> Column:
    tail = r"(?:'s)?\b" if possessive else r"\b"
    return F.concat(F.lit(r"(?U)\b"), _literal(F.lower(name)), F.lit(tail))


def first_word(c: Column) -> Column:
    """First word of a name; '' for a name without letters or digits."""
    return F.regexp_extract(F.lower(c), r"[\p{L}\p{N}_]+", 0)


def name_candidates(queries: DataFrame, names: DataFrame, possessive: bool, text: str = "q") -> DataFrame:
    """(query_id, names): the user's known names that occur in the query, longest first, ties alphabetical.

    A name that occurs at word boundaries has its first word as a whole word of the query, so joining on that word
    finds every occurrence.
    """
    words = F.concat(F.array(F.lit("")), F.array_distinct(tx.word_list(F.col(text))))
    asked = queries.select("query_id", "user_id", text, F.explode(words).alias("_word"))
    known = names.filter("name <> ''").select("user_id", "name", first_word(F.col("name")).alias("_word")).distinct()
    hits = asked.join(known, ["user_id", "_word"]).filter(F.rlike(F.col(text), name_pattern(F.col("name"), possessive)))
    ranked = F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), F.col("name"))))
    return hits.groupBy("query_id").agg(F.transform(ranked, lambda s: s["name"]).alias("names"))


def _take_all(text: Column, values: Column, pattern, label) -> Column:
    """Fold: remove the first match of every value still present; struct(text, found labels in order)."""
    start = F.struct(text.alias("text"), F.array().cast(_NO_NAMES).alias("found"))

    def step(acc: Column, value: Column) -> Column:
        p = pattern(value)
        taken = F.struct(
            remove_first(acc["text"], p).alias("text"),
            F.array_distinct(F.concat(acc["found"], F.array(label(value)))).alias("found"),
        )
        return F.when(F.rlike(acc["text"], p), taken).otherwise(acc)

    return F.aggregate(values, start, step)


def match_names(queries: DataFrame, names: DataFrame, out: str, possessive: bool = False, text: str = "q") -> DataFrame:
    """Adds `out`, the known names mentioned (longest first), and removes them from the text column."""
    found = name_candidates(queries, names, possessive, text).withColumnRenamed("names", "_names")
    fold = _take_all(F.col(text), F.col("_names"), lambda n: name_pattern(n, possessive), lambda n: n)
    df = queries.join(found, "query_id", "left").withColumn("_taken", F.when(F.col("_names").isNotNull(), fold))
    return df.withColumns(
        {text: F.coalesce("_taken.text", text), out: F.coalesce("_taken.found", F.array().cast(_NO_NAMES))}
    ).drop("_names", "_taken")


_KINDS_BY_LENGTH = sorted(fv.KIND_WORDS.items(), key=lambda kv: -len(kv[0]))
_ANY_KIND = r"(?U)\b(" + "|".join(word for word, _ in _KINDS_BY_LENGTH) + r")\b"


def match_kinds(text: Column) -> Column:
    """struct(text, found): kind words taken out of a lower-case text, longest word first."""
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w, k in _KINDS_BY_LENGTH])
    fold = _take_all(text, words, lambda v: F.concat(F.lit(r"(?U)\b"), v["w"], F.lit(r"\b")), lambda v: v["k"])
    nothing = F.struct(text.alias("text"), F.array().cast(_NO_NAMES).alias("found"))
    return F.when(text.rlike(_ANY_KIND), fold).otherwise(nothing)


def visual_text(text: Column) -> Column:
    """What should be visible: filler, generic nouns and stray prepositions removed; null when nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(text, f"(?U){fv.FILLER_WORDS}", " "), f"(?U){fv.GENERIC_WORDS}", " ")
    rest = F.regexp_replace(tx.strip(rest), rf"(?U)\b({fv.EDGE_WORDS})\s*\z", " ")
    rest = F.regexp_replace(rest, rf"(?U)^\s*({fv.EDGE_WORDS})\b", " ")
    return F.nullif(F.btrim(F.regexp_replace(rest, tx.SPACE, " "), F.lit(" ,.-")), F.lit(""))


def distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct (user_id, lower text, today), link query_id -> asked_id).

    Repeated queries are understood once; join the answers back with the link.
    """
    key = ["user_id", "today", "_text"]
    keyed = queries.withColumn("_text", F.lower(F.trim("text")))
    first = keyed.groupBy(*key).agg(F.min_by(F.struct(*queries.columns), "query_id").alias("r"))
    link = keyed.select("query_id", *key).join(first.select(*key, F.col("r.query_id").alias("asked_id")), key)
    return first.select("r.*"), link.select("query_id", "asked_id")


def understand_queries(queries: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """Adds people, places, kinds (arrays), date_from, date_to, months, visual_query and source to query texts.

    `queries`: query_id, user_id, text, today. `people`: user_id, name. `places`: user_id, place.
    """
    df = queries.withColumn("q", F.concat(F.lit(" "), F.lower(tx.strip(F.col("text"))), F.lit(" ")))
    df = match_names(df, people, "people", possessive=True)
    df = match_names(df, places.select("user_id", F.col("place").alias("name")), "places")
    df = df.withColumn("_k", match_kinds(F.col("q")))
    df = df.withColumns({"q": F.col("_k.text"), "kinds": F.col("_k.found")}).drop("_k")
    df = df.withColumn("_d", date_phrase(F.col("q"), F.col("today")))
    rest = F.when(F.col("_d").isNull(), F.col("q")).otherwise(remove_first(F.col("q"), F.col("_d.pattern")))
    no_months = F.array().cast("array<int>")
    df = df.withColumns(
        {
            "q": rest,
            "date_from": F.col("_d.date_from"),
            "date_to": F.col("_d.date_to"),
            "months": F.when(F.col("_d.month").isNotNull(), F.array("_d.month")).otherwise(no_months),
        }
    )
    return df.withColumn("visual_query", visual_text(F.col("q"))).withColumn("source", F.lit("local")).drop("q", "_d")


# ---------------------------------------------------------------- model answers
@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _rare_pairs(w: Column) -> Column:
    """Pairs of the rarest characters of a word of two to five, marked as no run of two; of four one is left out, of five one, of fewer none."""
    by_rarity = F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.struct(F.instr(F.lit(fv.LETTERS_BY_RARITY), c).alias("r"), c.alias("c")))
    rare = F.slice(F.array_sort(by_rarity), F.lit(1), F.least(F.length(w), F.greatest(F.lit(3), F.length(w) - 1)))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(rare) - 2))
    return F.flatten(F.transform(at, lambda i: F.transform(F.slice(rare, i + 2, F.size(rare)), lambda y: F.concat(F.lit("+"), F.get(rare, i)["c"], y["c"]))))


def similar_words(left: DataFrame, right: DataFrame, min_ratio: float = fv.NAME_SIMILARITY) -> DataFrame:
    """Pairs (user_id, lword, rword) that are equal or whose difflib ratio reaches min_ratio (at least 0.75).

    Exact blocking. Matched characters form at most one run more than there are unmatched ones, so at 0.75 two words of more than eight
    characters together share two neighbouring characters. Shorter words share at least two characters in any order (a word of one, itself): at
    least three of four or five, two of two or three. So they share two of the rarest that are left when all but one of these are taken
    away from the end of their characters, rarest first (`_rare_pairs`); no single letter is a key. Distinct words only; the ratio's upper bound from
    the lengths is checked before Python.
    """

    def grams(df: DataFrame, word: str) -> DataFrame:
        w = F.col(word)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substr(w, i, F.lit(2)))
        pairs = F.when(F.length(w).between(2, 5), _rare_pairs(w)).otherwise(F.array().cast("array<string>"))
        return df.select("user_id", word).distinct().select("user_id", word, F.explode(F.array_distinct(F.concat(runs, pairs))).alias("_gram"))

    met = grams(left, "lword").join(grams(right, "rword"), ["user_id", "_gram"])
    total = F.length("lword") + F.length("rword")
    possible = 2.0 * F.least(F.length("lword"), F.length("rword")) / total >= min_ratio
    short = (F.length("_gram") == 2) | (total <= 8)  # pairs hold for short words only
    pairs = met.filter(possible & short).select("user_id", "lword", "rword").distinct()
    equal = F.col("lword") == F.col("rword")
    asked = pairs.withColumn("_r", F.when(equal, F.lit(1.0)).otherwise(_ratio("lword", "rword")))
    return asked.filter(F.col("_r") >= min_ratio).select("user_id", "lword", "rword")


def mentioned(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, user_id, name): names of which every word equals or resembles some word of the query text."""
    qw = queries.select("query_id", "user_id", F.explode(F.array_distinct(tx.word_list(F.col("text")))).alias("lword"))
    parts = names.select("user_id", "name", F.array_distinct(tx.word_list(F.col("name"))).alias("_parts")).distinct()
    nw = parts.select("user_id", "name", F.size("_parts").alias("_n"), F.explode("_parts").alias("rword"))
    close = similar_words(qw, nw)
    hits = qw.join(close, ["user_id", "lword"]).join(nw, ["user_id", "rword"])
    seen = hits.groupBy("query_id", "user_id", "name", "_n").agg(F.count_distinct("rword").alias("_found"))
    return seen.filter("_found = _n").select("query_id", "user_id", "name")


def strip_model_text(text: Column, today: Column, kinds: Column, names: Column) -> Column:
    """The visual part a model wrote, without dates, words of kinds already filtered, known names and generic nouns.

    `text` and `names` must be columns (lower-case matching; longest names first).
    """
    undated = strip_dates(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), today)
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w, k in _KINDS_BY_LENGTH])
    chosen = F.filter(words, lambda v: F.array_contains(kinds, v["k"]))

    def drop(acc: Column, pattern: Column) -> Column:
        return F.regexp_replace(acc, pattern, F.lit(" "))

    out = F.aggregate(chosen, undated, lambda acc, v: drop(acc, F.concat(F.lit(r"(?iU)\b"), v["w"], F.lit(r"\b"))))
    out = F.aggregate(names, out, lambda acc, n: drop(acc, name_pattern(n, possessive=True)))
    out = F.regexp_replace(out, f"(?iU){fv.GENERIC_WORDS}", " ")
    out = F.btrim(F.regexp_replace(out, tx.SPACE, " "), F.lit(" ,.-"))
    edge = "in|at|of|with|and|from"
    out = tx.strip(F.regexp_replace(out, rf"(?i)^(?:{edge})\s+|\s+(?:{edge})\z", ""))
    return F.when(F.coalesce(text, F.lit("")) != "", F.nullif(out, F.lit("")))


def merge_extracted(rules: DataFrame, extracted: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """Combine rule answers with what a model extracted.

    `rules`: output of `understand_queries`. `extracted`: query_id, visual_query, people, places, kinds (arrays). Only
    names that are known (case ignored) and resemble words of the query are believed, only valid kinds; dates come from
    rules alone. Queries without an extraction keep the rules' answer.
    """
    rules = cut_lineage(rules)  # read by every branch below
    base = rules.select("query_id", "user_id", "text")

    def believed(column: str, names: DataFrame) -> DataFrame:
        said = extracted.select("query_id", F.posexplode(column).alias("_at", "_said"))
        # each user's names once per spelling; the model's answer is matched on its lower-case form
        known = names.groupBy("user_id", F.lower("name").alias("_low")).agg(F.min("name").alias("name"))
        real = said.withColumn("_low", F.lower("_said")).join(base, "query_id").join(known, ["user_id", "_low"])
        sure = mentioned(base, real.select("user_id", F.col("_said").alias("name")).distinct())
        kept = real.join(sure.select("query_id", F.col("name").alias("_said")), ["query_id", "_said"], "left_semi")
        ordered = F.array_sort(F.collect_list(F.struct("_at", "name")))
        return kept.groupBy("query_id").agg(F.transform(ordered, lambda s: s["name"]).alias(f"_{column}"))

    place_names = places.select("user_id", F.col("place").alias("name"))
    empty = F.array().cast(_NO_NAMES)
    low_text = base.select("query_id", "user_id", F.lower("text").alias("q"))
    every = people.select("user_id", "name").unionByName(place_names)
    said_text = extracted.select("query_id", F.col("visual_query").alias("_visual"), F.col("kinds").alias("_kinds"))
    in_visual = name_candidates(
        said_text.join(low_text.drop("q"), "query_id").withColumn("q", F.lower(F.coalesce("_visual", F.lit("")))), every, True
    ).withColumnRenamed("names", "_strip")
    df = (
        rules.join(said_text.withColumn("_hit", F.lit(True)), "query_id", "left")
        .join(believed("people", people.select("user_id", "name")), "query_id", "left")
        .join(believed("places", place_names), "query_id", "left")
        .join(in_visual, "query_id", "left")
    )
    valid = F.filter(F.coalesce("_kinds", empty), lambda k: k.isin(*fv.KINDS))
    df = df.withColumns(
        {
            "people": tx.ordered_unique(F.col("people"), F.coalesce("_people", empty)),
            "places": tx.ordered_unique(F.col("places"), F.coalesce("_places", empty)),
            "kinds": tx.ordered_unique(F.col("kinds"), valid),
        }
    )
    stripped = strip_model_text(F.col("_visual"), F.col("today"), F.col("kinds"), F.coalesce("_strip", empty))
    return df.withColumns(
        {
            "visual_query": F.when(F.col("_hit"), stripped).otherwise(F.col("visual_query")),
            "source": F.when(F.col("_hit"), "llm").otherwise(F.col("source")),
        }
    ).drop("_visual", "_kinds", "_hit", "_people", "_places", "_strip")
