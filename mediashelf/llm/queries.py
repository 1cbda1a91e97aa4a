"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automata, chat, decontaminate, langid, mixing, repeats, runs, sharding, simhash, topk, toxicity, urls, whitening
from .common import WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    """Register fn(t) under its name; t(name) reads a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_mix_sources(t):
    """Words each document gives to the mix."""
    return mixing.mix(t("documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mix_sources"] = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sizes as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, (array[5, 2, 1])[(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1] as w,
    row_number() over (order by encode(source) nulls last) as rank, 2 * source_size as cap, sum(source_size) over () as total from sizes
), levels as (
  select *, cap * (10 // w) as meets, total::hugeint * 150 - 100 * coalesce(sum(cap) over (order by cap * (10 // w), rank rows between unbounded preceding and 1 preceding), 0) as num,
    100 * sum(w) over (order by cap * (10 // w), rank rows between current row and unbounded following) as den from ranked
), open as (
  select num, den, meets, rank from levels where num * w <= cap * den order by meets, rank limit 1
), targets as (
  select source, source_size, case when open.rank is not null and (levels.meets > open.meets or levels.meets = open.meets and levels.rank >= open.rank)
    then (w * open.num)::double / open.den::double else cap::double end as target
  from levels left join open on true
), rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated
"""


@query
def op5_shard(t):
    """Forty shards of near equal bytes, equal texts together."""
    placed = sharding.shard(t("documents").select("doc_id", "text"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op7_simhash_groups(t):
    """Near-duplicate groups of all documents by 64-bit fingerprints."""
    return simhash.near_duplicates(t("documents"))


@query
def op10_toxicity(t):
    """Toxicity of all documents; four fifths of the labelled ones teach."""
    docs, labels = t("documents").select("doc_id", "text"), t("labels")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = toxicity.scored(docs, labels, where=part != 0)
    return rows.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_language(t):
    """Language of all documents; two thirds of those with a language teach."""
    docs = t("documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.fit(docs, where=F.coalesce(part != 1, F.lit(True)))
    return langid.classify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_url_filter(t):
    """Verdicts on the urls of all pages."""
    return urls.judge(t("pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_chat_format(t):
    """All conversations and one whose texts are control strings, formatted; digests of what is read back."""
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


ORACLES["op3_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|im_start|>', '\l|im_start|>'), '<|im_end|>', '\l|im_end|>'),
    '<|endoftext|>', '\l|endoftext|>'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]'), '<<SYS>>', '\l<SYS>>'), '<</SYS>>', '\l</SYS>>') as body from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(role) + length(body))::bigint as formatted_chars
from escaped group by conv_id
"""


@query
def op2_top_k(t):
    """The five nearest other vectors of every fiftieth vector, by integer inner product."""
    vectors = topk.quantised(t("embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


ORACLES["op2_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query
def op6_decontaminate(t):
    """Benchmark texts held by documents."""
    return decontaminate.contaminated(t("documents"), t("benchmark"))


@query
def op4_remove_repeats(t):
    """What is left of all documents without strings of 200 bytes that also start elsewhere."""
    rows = repeats.remove_repeats(t("documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def with_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): one text in ten, by its key's checksum, gets a tail that repeats its words with a period; words parted by one blank."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.select(key, text, F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_llm_words"))
    n = F.greatest(F.size("_llm_words"), F.lit(1)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    placed = split.where(F.size("_llm_words") > 0).select(key, "_llm_words", a.alias("_llm_a"), p.alias("_llm_p"))
    moved = lambda word, at: F.get("_llm_words", F.when(at >= F.col("_llm_a"), F.col("_llm_a") + (at - F.col("_llm_a")) % F.col("_llm_p")).otherwise(at).cast("int"))
    tailed = placed.select(key, F.array_join(F.transform("_llm_words", moved), " ").alias(text))
    return split.where(F.coalesce(F.size("_llm_words") <= 0, F.lit(True))).select(key, text).union(tailed)


@query
def op11_periodic_runs(t):
    """Runs of repeated words in all documents, one in ten of which gets a periodic tail."""
    rows = runs.find_runs(with_periods(t("documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    named = rows.select("doc_id", "runs", "collapsed", line.alias("lines"), best.alias("best"))
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_substring_dedup(t):
    """What is left of all documents without windows of 35 words that also start elsewhere."""
    return automata.remove_repeats(t("documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op12_substring_dedup"] = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select r, i, hash(array_to_string(ws[i:i + 34], ' ')) as h, md5(array_to_string(ws[i:i + 34], ' ')) as m from docs, unnest(range(1, len(ws) - 33)) as u(i)
), twice as (
  select h, m from windows group by h, m having count(*) > 1
), gone as (
  select distinct r, i + j as p from windows join twice using (h, m), unnest(range(0, 35)) as v(j)
), counted as (
  select r, count(*) as n from gone group by r
), words as (
  select r, doc_id, ws[p] as w, p from docs, unnest(range(1, len(ws) + 1)) as x(p) where r in (select r from counted)
), kept as (
  select words.r, string_agg(w, ' ' order by words.p) as body from words left join gone on words.r = gone.r and words.p = gone.p where gone.p is null group by words.r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(case when n is null then array_to_string(ws, ' ') else coalesce(body, '') end) as kept_sha256
from docs left join counted on docs.r = counted.r left join kept on docs.r = kept.r
"""


@query
def op13_whiten(t):
    """All embeddings on the eight leading components of all of them."""
    return whitening.whiten(whitening.quantised(t("embeddings")))
