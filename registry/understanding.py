"""Understanding query texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediashelf.functions import dates as dt
from mediashelf.functions import fixed_values as fv
from mediashelf.functions import text as tx
from mediashelf.operators import library as lb
from mediashelf.operators import people as pp
from mediashelf.operators import understand as un

from . import query

TQ = ("text_queries", "people", "files")


def asked(t):
    return t("text_queries").withColumn("q", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")))


def names_sql(names, tail):
    return f"""with n as ({names}), m as (select q.query_id, n.name from text_queries q join n on n.user_id = q.user_id
      and regexp_matches(concat(' ', lower(q.text), ' '), concat('\\b', regexp_escape(lower(n.name)), '{tail}\\b')))
    select q.query_id, coalesce((select string_agg(name, ',' order by length(name) desc, name) from m where m.query_id = q.query_id), '') as found from text_queries q"""


@query("understand_people", names_sql("select distinct user_id, name from people where name is not null and not hidden", "(?:''s)?"), TQ)
def _(t, spark):
    out = un.match_names(asked(t), pp.named_people(t("people")), "people", possessive=True)
    return out.select("query_id", F.array_join("people", ",").alias("found"))


@query("understand_places", names_sql("select distinct user_id, unnest([place_area, place_city, place_region, place_country]) as name from files where place_name is not null", ""), TQ)
def _(t, spark):
    places = lb.known_places(t("files")).withColumnRenamed("place", "name")
    out = un.match_names(asked(t), places, "places")
    return out.select("query_id", F.array_join("places", ",").alias("found"))


KIND_VALUES = ", ".join(f"('{w}', '{k}', {i})" for i, (w, k) in enumerate(sorted(fv.KIND_WORDS.items(), key=lambda kv: -len(kv[0]))))
# texts that mention kinds: the language and source of documents, spelled as queries, before the whole text
KIND_TEXT = "concat(case when doc_id % 3 = 0 then 'my receipts and pdf from ' when doc_id % 3 = 1 then 'screen shots or charts of ' else 'documented billing ' end, case when doc_id % 5 = 0 then 'invoice scans ' else '' end, lower(text))"


@query(
    "understand_kinds",
    f"""with k(word, kind, n) as (values {KIND_VALUES}), q as (select doc_id, {KIND_TEXT} as q from documents),
    m as (select doc_id, kind, min(n) as n from q join k on regexp_matches(q.q, concat('\\b', word, '\\b')) group by all)
    select q.doc_id, coalesce((select string_agg(kind, ',' order by n) from m where m.doc_id = q.doc_id), '') as kinds from q""",
)
def _(t, spark):
    q = t("documents").select("doc_id", F.expr(KIND_TEXT).alias("q"))
    return q.select("doc_id", F.array_join(un.match_kinds(F.col("q"))["found"], ",").alias("kinds"))


PHRASES = (
    "last summer,yesterday,christmas 2023,in may,dogs may run,two years ago,march 2024,2022,last winter,past 3 weeks,last month,halloween 2021,today,this week,last week,this month,"
    "this year,last year,last 10 days,a year ago,new year's eve 2022,xmas eve 2020,summer,this autumn,fall 2019,winter 2020,december,sept 2021,past spring,last 2 months,3 years ago,from june"
)
N_PHRASES = PHRASES.count(",") + 1
MONTH_NO = "case substring({0}, 1, 3) " + " ".join(f"when '{m[:3]}' then {i}" for i, m in enumerate(fv.MONTHS, 1)) + " end"
ANY = "(" + "|".join([*fv.MONTHS, *[m[:3] for m in fv.MONTHS], "sept"]) + ")"
NOT_MAY = "(" + "|".join([m for m in [*fv.MONTHS, *[m[:3] for m in fv.MONTHS], "sept"] if m != "may"]) + ")"


def season_sql(season, year):
    first = f"case {season} when 'spring' then 3 when 'summer' then 6 when 'winter' then 12 else 9 end"
    last = f"case {season} when 'spring' then 5 when 'summer' then 8 when 'winter' then 2 else 11 end"
    return f"make_date({year}, {first}, 1)", f"last_day(make_date({year} + case when {season} = 'winter' then 1 else 0 end, {last}, 1))"


_S, _E = season_sql("sn", "y")
_S1, _E1 = season_sql("sn", "y - 1")
_SY, _EY = season_sql("sn", "cast(nullif(sy, '') as int)")
DATES_SQL = rf"""with t as (select event_id, cast(ts as date) + cast(event_id % 365 as int) as today, concat(' party ', split('{PHRASES.replace(chr(39), chr(39) * 2)}', ',')[event_id % {N_PHRASES} + 1], ' ') as q from events),
  g as (select *, cast(year(today) as int) as y, regexp_extract(q, '(last|this|past)?\s*(spring|summer|autumn|fall|winter)(?:\s+(\d{{4}}))?\b', 1) as rel, regexp_extract(q, '(last|this|past)?\s*(spring|summer|autumn|fall|winter)(?:\s+(\d{{4}}))?\b', 2) as sn,
    regexp_extract(q, '(last|this|past)?\s*(spring|summer|autumn|fall|winter)(?:\s+(\d{{4}}))?\b', 3) as sy, try_cast(regexp_extract(q, '(\d{{4}})', 1) as int) as yy,
    regexp_extract(q, '\b{ANY}\s+\d{{4}}\b', 1) as mw, regexp_extract(q, '\b(?:last|past)\s+(\d+)\s+(day|week|month|year)s?\b', 1) as n, regexp_extract(q, '\b(?:last|past)\s+(\d+)\s+(day|week|month|year)s?\b', 2) as unit,
    regexp_extract(q, '\b(\d+|a|one|two|three)\s+years?\s+ago\b', 1) as ago, regexp_extract(q, '\b(?:in|during|from)\s+(may)\b', 1) as may, regexp_extract(q, '\b{NOT_MAY}\b', 1) as bare from t),
  r as (select *, case when regexp_matches(q, '\b(christmas|xmas)( eve)?\s+\d{{4}}\b') then 'christmas' when regexp_matches(q, '\bnew year''?s?( eve)?\s+\d{{4}}\b') then 'new year' when regexp_matches(q, '\bhalloween\s+\d{{4}}\b') then 'halloween'
    when mw <> '' then 'my' when sn <> '' then 'season' when regexp_matches(q, '\btoday\b') then 'today' when regexp_matches(q, '\byesterday\b') then 'yesterday' when q like '% this week %' then 'tw' when q like '% last week %' then 'lw' when q like '% this month %' then 'tm'
    when q like '% last month %' then 'lm' when q like '% this year %' then 'ty' when q like '% last year %' then 'ly' when n <> '' then 'n' when ago <> '' then 'ago' when yy between 1950 and 2099 then 'year' when may <> '' or bare <> '' then 'm' end as rule from g),
  s as (select *, case when sy <> '' then {_SY} when (case when rel in ('last', 'past') then {_E} < today else {_S} <= today end) then {_S} else {_S1} end as s0,
    case when sy <> '' then {_EY} when (case when rel in ('last', 'past') then {_E} < today else {_S} <= today end) then least({_E}, today) else least({_E1}, today) end as s1 from r where true),
  z as (select *, case n when '' then 0 else cast(n as int) end * case unit when 'day' then 1 when 'week' then 7 when 'month' then 30 else 365 end as days, case when ago in ('a', 'one') then 1 when ago = 'two' then 2 when ago = 'three' then 3 else coalesce(try_cast(ago as int), 0) end as back from s)
  select event_id, case rule when 'christmas' then make_date(yy, 12, 24) when 'new year' then make_date(yy - 1, 12, 31) when 'halloween' then make_date(yy, 10, 31) when 'my' then make_date(yy, {MONTH_NO.format('mw')}, 1) when 'season' then s0
      when 'today' then today when 'yesterday' then today - 1 when 'tw' then cast(date_trunc('week', today) as date) when 'lw' then cast(date_trunc('week', today) as date) - 7 when 'tm' then cast(date_trunc('month', today) as date)
      when 'lm' then cast(date_trunc('month', cast(date_trunc('month', today) as date) - 1) as date) when 'ty' then make_date(y, 1, 1) when 'ly' then make_date(y - 1, 1, 1) when 'n' then today - cast(days as int) when 'ago' then make_date(y - back, 1, 1) when 'year' then make_date(yy, 1, 1) end as date_from,
    case rule when 'christmas' then make_date(yy, 12, case when q like '% eve %' then 24 else 26 end) when 'new year' then make_date(yy, 1, 1) when 'halloween' then make_date(yy, 10, 31) when 'my' then last_day(make_date(yy, {MONTH_NO.format('mw')}, 1)) when 'season' then s1
      when 'yesterday' then today - 1 when 'lw' then cast(date_trunc('week', today) as date) - 1 when 'lm' then cast(date_trunc('month', today) as date) - 1 when 'ly' then make_date(y - 1, 12, 31) when 'ago' then make_date(y - back, 12, 31) when 'year' then make_date(yy, 12, 31)
      when 'm' then null else case when rule is not null then today end end as date_to,
    cast(case when rule = 'm' then {MONTH_NO.format("coalesce(nullif(may, ''), bare)")} end as int) as month from z"""


def phrase_rows(t):
    phrases = PHRASES.replace("'", "\\'")
    return t("events").selectExpr(
        "event_id",
        "date_add(cast(ts as date), cast(event_id % 365 as int)) as today",
        f"concat(' party ', split('{phrases}', ',')[cast(event_id % {N_PHRASES} as int)], ' ') as q",
    )


def dated(t):
    rows = phrase_rows(t).withColumn("d", dt.date_phrase(F.col("q"), F.col("today")))
    return rows.select("event_id", "d.date_from", "d.date_to", "d.month")


@query("dt_query_range", DATES_SQL)
def _(t, spark):
    return dated(t)


REST_SQL = DATES_SQL.replace("select event_id, case rule when 'christmas'", "select event_id, case when rule is null then trim(q) else 'party' end as rest, case rule when 'christmas'")


@query("understand_dates", REST_SQL)
def _(t, spark):
    """Dates as the pipeline takes them: the rule's range, and what is left of the text."""
    rows = phrase_rows(t).withColumn("d", dt.date_phrase(F.col("q"), F.col("today")))
    rest = F.when(F.col("d").isNull(), F.col("q")).otherwise(dt.remove_first(F.col("q"), F.col("d.pattern")))
    return rows.select("event_id", tx.squeeze(rest).alias("rest"), "d.date_from", "d.date_to", "d.month")


VISUAL_SQL = rf"""with a as (select query_id, regexp_replace(regexp_replace(lower(text), '{fv.FILLER_WORDS}', ' ', 'g'), '{fv.GENERIC_WORDS}', ' ', 'g') as r from text_queries),
  b as (select query_id, regexp_replace(regexp_replace(trim(r), '\b({fv.EDGE_WORDS})\s*$', ' '), '^\s*({fv.EDGE_WORDS})\b', ' ') as r from a)
  select query_id, nullif(trim(regexp_replace(r, '\s+', ' ', 'g'), ' ,.-'), '') as visual from b"""


@query("understand_visual", VISUAL_SQL, ("text_queries",))
def _(t, spark):
    q = t("text_queries").select("query_id", F.lower("text").alias("q"))
    return q.select("query_id", un.visual_text(F.col("q")).alias("visual"))


def understood(t):
    return un.understand_queries(t("text_queries"), pp.named_people(t("people")), lb.known_places(t("files")))


# --- the whole chain in SQL: names, kinds, one date phrase and filler are taken out one after the other
PREP = fv.PREPOSITION
WORDS = ", ".join(f"'{w}'" for w, _ in sorted(fv.KIND_WORDS.items(), key=lambda kv: -len(kv[0])))
RULE_NAMES = {
    "christmas": "christmas", "new year": "new year", "halloween": "halloween", "my": "month and year", "season": "season", "today": "today",
    "yesterday": "yesterday", "tw": "this week", "lw": "last week", "tm": "this month", "lm": "last month", "ty": "this year", "ly": "last year",
    "n": "last n", "ago": "years ago", "year": "year", "m": "month",
}
RULE_PATTERN = "case rule " + " ".join(f"when '{r}' then '{dt.DATE_PATTERNS[n].replace(chr(39), chr(39) * 2)}'" for r, n in RULE_NAMES.items()) + " end"


def _drop_names(text, names, tail):
    return rf"list_reduce(list_prepend({text}, {names}), lambda acc, n: regexp_replace(acc, concat('{PREP}\b', regexp_escape(lower(n)), '{tail}\b'), ' '))"


DATES_CTE, DATES_SELECT = DATES_SQL.split("\n  select event_id, ", 1)
UNDERSTOOD_CTE = rf"""npeople as (select distinct user_id, name from people where name is not null and not hidden),
  nplaces as (select * from (select distinct user_id, unnest([place_area, place_city, place_region, place_country]) as name from files where place_name is not null) x where name is not null),
  u0 as (select query_id, user_id, text, today, concat(' ', lower(trim(text)), ' ') as q0 from text_queries),
  u1 as (select *, coalesce((select list(name order by length(name) desc, name) from npeople where npeople.user_id = u0.user_id and regexp_matches(q0, concat('\b', regexp_escape(lower(name)), '(?:''s)?\b'))), []) as people from u0),
  u2 as (select *, {_drop_names('q0', 'people', "(?:''s)?")} as q1 from u1),
  u3 as (select *, coalesce((select list(name order by length(name) desc, name) from nplaces where nplaces.user_id = u2.user_id and regexp_matches(q1, concat('\b', regexp_escape(lower(name)), '\b'))), []) as places from u2),
  u4 as (select *, {_drop_names('q1', 'places', '')} as q2 from u3),
  kwd(word, kind, n) as (values {KIND_VALUES}),
  u5 as (select *, coalesce((select list(kind order by n) from (select kind, min(n) as n from kwd where regexp_matches(q2, concat('\b', word, '\b')) group by kind) x), []) as kinds,
    list_reduce(list_prepend(q2, [{WORDS}]), lambda acc, n: regexp_replace(acc, concat('{PREP}\b', n, '\b'), ' ')) as q from u4),
  """ + DATES_CTE.split("events),", 1)[1].replace("from t),", "from (select query_id as event_id, * from u5) t),", 1) + rf""",
  u6 as (select event_id as query_id, user_id, text, people, places, kinds, rule, {DATES_SELECT.rsplit(" from z", 1)[0]}, case when rule is null then q else regexp_replace(q, concat('{PREP}', {RULE_PATTERN}), ' ') end as q4 from z),
  u7 as (select *, regexp_replace(regexp_replace(q4, '{fv.FILLER_WORDS}', ' ', 'g'), '{fv.GENERIC_WORDS}', ' ', 'g') as r1 from u6),
  u8 as (select *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(r1), '\b({fv.EDGE_WORDS})\s*$', ' '), '^\s*({fv.EDGE_WORDS})\b', ' '), '\s+', ' ', 'g'), ' ,.-'), '') as visual_query from u7)"""


@query(
    "understand_queries",
    f"with {UNDERSTOOD_CTE} select query_id, coalesce(array_to_string(people, ','), '') as people, coalesce(array_to_string(places, ','), '') as places, coalesce(array_to_string(kinds, ','), '') as kinds, date_from, date_to, month, visual_query from u8",
    TQ,
)
def _(t, spark):
    lists = [F.array_join(c, ",").alias(c) for c in ("people", "places", "kinds")]
    month = F.get("months", F.lit(0)).alias("month")
    return understood(t).select("query_id", *lists, "date_from", "date_to", month, "visual_query")


def model_answers(t):
    """What a model might say: the text itself as visual part, names in another spelling and unknown ones."""
    people = F.expr("filter(split('Rahul,rahul,Maya,Leo,Zoe,Nobody', ','), x -> contains(lower(text), lower(x)) or x = 'Nobody')")
    places = F.expr("filter(split('GOA,Mumbai,Lisbon,india,Atlantis', ','), x -> contains(lower(text), lower(x)) or x = 'Atlantis')")
    return t("text_queries").select(
        "query_id", F.col("text").alias("visual_query"), people.alias("people"), places.alias("places"), F.array(F.lit("photo"), F.lit("hologram")).alias("kinds")
    )


@query("join_model_extract")
def _(t, spark):
    return un.merge_extracted(understood(t), model_answers(t), pp.named_people(t("people")), lb.known_places(t("files")))


@query("join_fuzzy_name")
def _(t, spark):
    typos = t("text_queries").withColumn("text", F.translate("text", "aeR", "eaR"))
    return un.mentioned(typos, pp.named_people(t("people")))


def strip_sql(text: str, kinds: tuple[str, ...], names: tuple[str, ...]) -> str:
    """What a model wrote without dates (each text has one of the phrases at most), words of the kinds, names and generic nouns."""
    dates = rf"{fv.PREPOSITION}(?:\b(?:last|past)\s+(?:summer|winter)\b|\byesterday\b|\bchristmas\s+\d{{4}}\b|\bin\s+may\b|\btwo\s+years\s+ago\b|\bmarch\s+\d{{4}}\b|\bpast\s+\d+\s+weeks\b|\blast\s+month\b|\bhalloween\s+\d{{4}}\b|\b2022\b)"
    out = f"regexp_replace(concat(' ', lower({text}), ' '), '{dates}', ' ')"
    for word in [w for w, k in sorted(fv.KIND_WORDS.items(), key=lambda kv: -len(kv[0])) if k in kinds]:
        out = f"regexp_replace({out}, '\\b{word}\\b', ' ', 'g')"
    for name in names:
        out = f"regexp_replace({out}, '\\b{name.lower()}(?:''s)?\\b', ' ', 'g')"
    out = rf"trim(regexp_replace(regexp_replace({out}, '{fv.GENERIC_WORDS}', ' ', 'g'), '\s+', ' ', 'g'), ' ,.-')"
    return rf"nullif(trim(regexp_replace({out}, '^(?:in|at|of|with|and|from)\s+|\s+(?:in|at|of|with|and|from)$', '', 'g')), '')"


@query("understand_strip", f"select query_id, {strip_sql('text', ('receipt', 'screenshot'), ('Rahul', 'Maya', 'Lisbon', 'Goa'))} as visual from text_queries", ("text_queries",))
def _(t, spark):
    q = t("text_queries").withColumn("names", F.split(F.lit("Rahul,Maya,Lisbon,Goa"), ","))
    kinds = F.array(F.lit("receipt"), F.lit("screenshot"))
    return q.select("query_id", un.strip_model_text(F.col("text"), F.col("today"), kinds, F.col("names")).alias("visual"))


@query(
    "understand_dedupe",
    "select query_id, min(query_id) over (partition by user_id, lower(trim(text)), today) as asked_id from text_queries",
    ("text_queries",),
)
def _(t, spark):
    return un.distinct_queries(t("text_queries"))[1]
