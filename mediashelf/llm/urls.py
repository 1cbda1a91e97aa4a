"""URL filters: host names are split into words, then naive Bayes scores the words of host and path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashelf.session import cut_lineage

#: (verdict, host, beginning of the path): the rules of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words in a host that mark a page as one to block when the classifier is fitted.
MARKS = ("ads", "adult", "bet", "bets", "betting", "casino", "malware", "pills", "phish", "porn", "sex", "spam", "viagra", "warez", "xxx")

#: The longest word of the unigram model, in letters: words of host names are not longer.
LONGEST = 24

#: Longer runs of letters are no host name (a whole one has 253 characters at most) and stay one part.
LONGEST_NAME = 253

#: What an unknown letter costs in a segmentation, in nats: more than any known word's share of letters.
UNKNOWN = 12.0

#: A word must be met this often to be one of the unigram model.
LEAST = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a url: after the first `://` up to `/`, `?`, `#` or the end, then up to `?`, `#` or the end; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's; null if none.

    Among equally long ones the first by text wins.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in order]), pick([v for v, _, _ in order])


def pieces(of: Column) -> Column:
    """The runs of letters of a host or path, A-Z as a-z."""
    return F.regexp_extract_all(F.lower(of), F.lit(r"[a-z]+"), 0)


def unigrams(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(word, n): how often each word is met in urls and, tags aside, in the pages, at least LEAST times; counts cover all rows."""
    host, path = host_and_path(F.col(url))
    texts = [pieces(F.concat_ws(" ", host, path))]
    if html is not None:
        texts.append(pieces(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*>", " ")))
    words = pages.select(F.explode(F.concat(*texts)).alias("word")).where(F.length("word") <= LONGEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, parts) for each name (runs of letters, each once): its likeliest split into words under the unigram model.

    Every stretch of a name of at most LONGEST letters meets the model in a join, so the model is never shipped; what was found returns
    to the name, at most LONGEST entries a letter, and Viterbi over them picks the split of the highest probability.
    Letters in no known word stand together as a part of their own.
    """
    total = words.agg(F.sum("n")).head()[0] or 1
    spans = names.where(F.length("name") <= LONGEST_NAME).select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, F.lit(LONGEST)))).alias("at", "tail"))
    stretches = spans.select("name", "at", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda n: F.substring(F.col("tail"), F.lit(1), n))).alias("word"))
    found = stretches.join(words, "word").select("name", "at", F.length("word").alias("long"), (F.log(F.col("n") / F.lit(total))).alias("logp"))
    lattice = found.groupBy("name").agg(F.collect_list(F.struct("at", "long", "logp")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "parts": [[n] if len(n) > LONGEST_NAME else best_split(n, [] if f is None else [(x["at"], x["long"], x["logp"]) for x in f]) for n, f in zip(b["name"], b["found"], strict=True)]})

    return names.join(lattice, "name", "left").mapInPandas(run, "name string, parts array<string>")


def best_split(name: str, found: list[tuple[int, int, float]]) -> list[str]:
    """The split of the highest sum of log probabilities; of equal ones the one whose last part is longest."""
    at_end: dict[int, list[tuple[int, float]]] = {}
    for at, long, logp in found:
        at_end.setdefault(at + long, []).append((at, logp))
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for end in range(1, len(name) + 1):
        ways = [(best[end - 1][0] - UNKNOWN, -(end - 1), False)] + [(best[at][0] + logp, -at, True) for at, logp in at_end.get(end, [])]
        value, at, known = max(ways)
        best.append((value, -at, known))
    parts: list[tuple[str, bool]] = []
    end = len(name)
    while end:
        _, at, known = best[end]
        if parts and not known and not parts[-1][1]:
            parts[-1] = (name[at:end] + parts[-1][0], False)
        else:
            parts.append((name[at:end], known))
        end = at
    return [p for p, _ in reversed(parts)]


def judge(pages: DataFrame, url: str = "url", html: str | None = "html", *, rules: Sequence[tuple[str, str, str]] = RULES, marks: Sequence[str] = MARKS) -> DataFrame:
    """Every row with `host`, `path`, `rule` (null if none fits) and `verdict`: the rule's, else that of naive Bayes.

    Hosts are split at signs and then, by `segment`, into words; paths at signs. A url is one to block for the fit if a
    word of its host is one of `marks`; words of urls are then counted by class over all rows (each distinct set of words with
    its number of urls), smoothed by one, and a url is blocked if its words are likelier in the blocked class.

    Work runs over distinct word lists, which hosts and numbered paths share, so a host with a third of all pages is one
    list; verdicts return by a join that Spark splits where a list is hot. Null urls and urls without `://` have empty host and path
    and, having no words, are allowed; repeated rows are judged alike; no pages give no rows; input columns named like a result are
    replaced.
    """
    host, path = host_and_path(F.col(url))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*(F.col(f"`{c}`") for c in kept), host.alias("host"), path.alias("path")).withColumns({"_llm_names": pieces(F.col("host")), "_llm_words": pieces(F.col("path"))})
    marked = parsed.withColumn("_llm_list", F.concat(F.array_join("_llm_names", " "), F.lit("/"), F.array_join("_llm_words", " ")))

    lists = cut_lineage(marked.select("_llm_list", "_llm_names", "_llm_words").groupBy("_llm_list").agg(F.first("_llm_names").alias("_llm_names"), F.first("_llm_words").alias("_llm_words"), F.count("*").alias("n")))
    names = lists.select(F.explode("_llm_names").alias("name")).distinct()
    split = cut_lineage(segment(names, cut_lineage(unigrams(pages, url, html))))
    in_host = lists.select("_llm_list", "n", F.explode("_llm_names").alias("name")).join(split, "name").select("_llm_list", "n", F.explode("parts").alias("token"), F.lit(True).alias("host"))
    in_path = lists.select("_llm_list", "n", F.explode("_llm_words").alias("token"), F.lit(False).alias("host"))
    tokens = cut_lineage(in_host.union(in_path))
    blocked = tokens.groupBy("_llm_list").agg(F.max(F.col("host") & F.col("token").isin(*marks)).alias("bad"))
    classed = tokens.join(blocked, "_llm_list")
    counts = classed.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    counts = cut_lineage(counts)
    sums = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("*").alias("words")).head()
    urls = lists.join(blocked, "_llm_list", "left").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all")).head()
    bad, of = urls["bad"] or 0, urls["all"] or 0
    weight = counts.select("token", (F.log((F.col("bad") + 1) / (sums["bad"] + sums["words"] + 1)) - F.log((F.col("good") + 1) / (sums["good"] + sums["words"] + 1))).alias("w"))
    prior = F.log(F.lit((bad + 1) / (of - bad + 1)))
    odds = tokens.join(weight, "token").groupBy("_llm_list").agg((F.sum("w") + prior).alias("_llm_odds"))
    verdicts = cut_lineage(odds.select(F.col("_llm_list").alias("_llm_of"), (F.col("_llm_odds") > 0).alias("_llm_block")))
    joined = marked.join(verdicts, F.col("_llm_list") == F.col("_llm_of"), "left")
    own = F.when(F.col("_llm_block"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(*(F.col(f"`{c}`") for c in kept), "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"))
