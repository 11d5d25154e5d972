"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, licenses, linededup, mixing, quality, secret_scan, simhash, token_io, topk, toxicity
from millrace.llm.base import load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(load(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(load(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(load(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(load(spark, sf_dir, "documents"))


def _weights(column: str, given: dict[str, int], default: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in sorted(given.items())) + f" else {default} end" if given else str(default)


def _split_sql(children: str, parent: str, name: str, weights: str) -> str:
    """The closed form of ``mixing.split`` as SQL over (parent, name, capacity, budget)."""
    over = f"partition by {parent}" if parent else ""
    columns = f"{parent}, {name}" if parent else name
    return f"""
        select {columns}, capacity,
               case when is_full then capacity
                    else cast(((budget - c_full) * cast(w as hugeint)) // w_open as bigint) end as alloc
        from (select *, coalesce(sum(capacity) filter (is_full) over ({over}), 0) as c_full,
                     coalesce(sum(w) filter (not is_full) over ({over}), 0) as w_open
              from (select *, cast(capacity as hugeint) * w_rest <= cast(budget - c_before as hugeint) * w as is_full
                    from (select *, coalesce(sum(capacity) over (q rows between unbounded preceding and 1 preceding), 0) as c_before,
                                 sum(w) over (q rows between current row and unbounded following) as w_rest
                          from (select *, {weights} as w from ({children}))
                          window q as ({over} order by capacity / w, {name}))))"""


def mixing_sql(plan: mixing.Plan) -> str:
    domains = _split_sql(
        "select domain, sum(capacity) as capacity, max(total) as budget from leaves, budgets group by domain",
        "", "domain", _weights("domain", plan.domains, plan.default),
    )
    langs = _split_sql(
        "select l.domain, l.lang, sum(l.capacity) as capacity, max(d.alloc) as budget from leaves l join a1 d using (domain) group by l.domain, l.lang",
        "domain", "lang", _weights("lang", plan.languages, plan.default),
    )
    sources = _split_sql(
        "select l.domain, l.lang, l.source, l.capacity, a.alloc as budget from leaves l join a2 a using (domain, lang)",
        "domain, lang", "source", _weights("source", plan.sources, plan.default),
    )
    return f"""
    with named as (
        select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,
               coalesce(len(regexp_extract_all(text, '[^ \\t\\n]+')), 0) as n_tokens,
               regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1) as digits
        from documents),
    numbered as (select *, case when length(digits) between 1 and 9 then cast(digits as int) end as n from named),
    docs as (
        select doc_id, source, lang, n_tokens,
               case when n < 5 then 'web' when n < 10 then 'forum' when n < 15 then 'reference' when n >= 15 then 'news' else 'other' end as domain
        from numbered),
    leaves as (
        select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * {plan.max_epochs} as capacity
        from docs group by all),
    budgets as (select (coalesce(sum(tokens), 0) * {plan.share_percent}) // 100 as total from leaves),
    a1 as ({domains}), a2 as ({langs}), a3 as ({sources}),
    parts as (
        select domain, lang, source, case when tokens > 0 then alloc // tokens else 0 end as epochs,
               case when tokens > 0 then alloc % tokens else 0 end as rest
        from leaves join a3 using (domain, lang, source)),
    hashed as (
        select d.*, p.epochs, p.rest,
               cast('0x' || substr(md5('{plan.seed}:' || cast(p.epochs as varchar) || ':' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
        from docs d join parts p using (domain, lang, source)),
    ranked as (select *, sum(n_tokens) over (partition by domain, lang, source order by h, doc_id) as upto from hashed),
    timed as (select *, cast(epochs + case when rest > 0 and upto <= rest then 1 else 0 end as bigint) as times from ranked)
    select doc_id, domain, lang, source, cast(unnest(range(times)) as int) as epoch, cast(n_tokens as bigint) as n_tokens from timed"""


LINE_DEDUP_SQL = f"""
    with lines as (
        select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents),
    facts as (
        select *, cast('0x' || substr(md5(line), 1, 8) as bigint) as h,
               length(line) - length(replace(line, ' ', '')) + 1 >= {linededup.LONG} as long
        from lines),
    rolled as (
        select *, (xor(coalesce(lag(h) over d, 0) >> 1, h) & 1) = 0 as hit, coalesce(lag(long) over d, false) as after, count(*) over (partition by doc_id) as last
        from facts window d as (partition by doc_id order by i)),
    starts as (
        select *, i = 1 or long or after or (hit and not lag(hit) over (partition by doc_id order by i) and i >= 3 and i < last) as begins
        from rolled),
    numbered as (select *, sum(cast(begins as int)) over (partition by doc_id order by i) as chunk from starts),
    chunks as (
        select doc_id, chunk, string_agg(line, chr(10) order by i) as body, count(*) as n, count(*) > 1 or bool_or(long) as counts
        from numbered group by doc_id, chunk),
    marked as (
        select *, counts and row_number() over (partition by body, counts order by doc_id, chunk) > 1 as gone from chunks)
    select doc_id, coalesce(string_agg(body, chr(10) order by chunk) filter (not gone), '') as text,
           cast(sum(n) as int) as n_lines, cast(coalesce(sum(n) filter (gone), 0) as int) as removed_lines,
           cast(count(*) filter (gone) as int) as removed_chunks
    from marked group by doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_ids": op2_token_ids,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_exact_topk": op7_exact_topk,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE: dict[str, str] = {
    "op8_mixing": mixing_sql(mixing.Plan()),
    "op10_line_dedup": LINE_DEDUP_SQL,
}
