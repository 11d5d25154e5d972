"""The registered queries of the miner's operators, each with the SQL that checks it.

A query applies an operator of this library to one of the message views; its SQL gives
the same rows by other means. Queries without SQL are alignments, tries and engines,
which the tests compare with plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.align import merge_templates_udf, wild_align_udf
from millrace.functions.rules import REWRITES, collapse, correct_template, mask_common, mask_digits, mask_paths, mask_word_variables, rewritten
from millrace.operators import evaluate as ev
from millrace.operators import relational as rel
from millrace.operators import sampling, similarity
from millrace.operators.groundtruth import assign_events, build_groundtruth, event_ids, template_counts
from millrace.operators.match import cover_pairs, regex_match, template_upsert, trie_match
from millrace.operators.trie import build
from millrace.plans import views as v
from millrace.plans.engine import Miner
from millrace.plans.prompts import EXTRACT, EXTRACT_EXAMPLE, MERGE, MERGE_EXAMPLE, extract_prompt, merge_prompt
from millrace.sources import readers, sinks
from millrace.sources.formats import compile_format, malformed_lines, parse_lines
from millrace.sources.sinks import transposed
from millrace.staging import new_path
from millrace.streaming.online import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return keep


def _project(view: Callable[[SparkSession, str], DataFrame], **columns) -> Query:
    return lambda spark, sf_dir: view(spark, sf_dir).select("LineId", *(c.alias(n) for n, c in columns.items()))


# -- sources and lines -------------------------------------------------------------


@register(f"select doc_id, cast(pos as int) as pos, regexp_replace(value, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') as value from {v.DOCUMENT_LINES_SQL}")
def scan_lines(spark, sf_dir):
    """Stripped lines of all documents."""
    return v.document_lines(spark, sf_dir).select("doc_id", "pos", tx.strip(F.col("value")).alias("value"))


_ORDER_RE = r"^\[(.*?)\]\s+(.*?)\s+-\s+order\s+(.*?)\s+priority\s+(.*?)$"


@register(f"""select o_orderkey, regexp_extract(value, '{_ORDER_RE}', 1) as "Date", regexp_extract(value, '{_ORDER_RE}', 2) as "Status",
    regexp_extract(value, '{_ORDER_RE}', 3) as "Order", regexp_extract(value, '{_ORDER_RE}', 4) as "Content"
    from {v.ORDERS_SQL} where regexp_matches(value, '{_ORDER_RE}')""")
def format_extract(spark, sf_dir):
    """Header fields of the lines that follow a format."""
    return parse_lines(v.orders_lines(spark, sf_dir), compile_format(v.ORDER_FORMAT))


@register(f"select o_orderkey, value from {v.ORDERS_SQL} where not regexp_matches(value, '{_ORDER_RE}')")
def format_filter(spark, sf_dir):
    """The lines that do not follow the format."""
    return malformed_lines(v.orders_lines(spark, sf_dir), compile_format(v.ORDER_FORMAT))


@register(f"""select row_number() over (order by o_orderkey) as "LineId", o_orderkey, regexp_extract(value, '{_ORDER_RE}', 4) as "Content"
    from {v.ORDERS_SQL} where regexp_matches(value, '{_ORDER_RE}')""")
def dense_line_id(spark, sf_dir):
    """Dense numbers of the lines that follow the format."""
    parsed = parse_lines(v.orders_lines(spark, sf_dir), compile_format(v.ORDER_FORMAT))
    return rel.dense_line_id(parsed.select("o_orderkey", "Content"), ["o_orderkey"])


_SPACED = "concat('  ', replace(Content, ' ', if(LineId % 2 = 0, '   ', '\\t ')), ' \\t')"
_SPACED_SQL = "concat('  ', replace(Content, ' ', case when LineId % 2 = 0 then '   ' else chr(9) || ' ' end), ' ' || chr(9))"


@register(f"""select LineId as "LineId", trim(regexp_replace({_SPACED_SQL}, '\\s+', ' ', 'g')) as message from {v.EVENTS_SQL}""")
def normalize_ws(spark, sf_dir):
    return v.events(spark, sf_dir).select("LineId", tx.normalize_ws(F.expr(_SPACED)).alias("message"))


@register(f"""select LineId as "LineId", position(' ' in Content) = 0 as single from {v.URLS_SQL}
    union all select -LineId, position(' ' in Content) = 0 from {v.EVENTS_SQL}""")
def route_single(spark, sf_dir):
    """Which messages are one token: web addresses are, events are not."""
    both = v.urls(spark, sf_dir).select("LineId", "Content").unionAll(v.events(spark, sf_dir).select(-F.col("LineId"), "Content"))
    return both.select("LineId", tx.is_single(F.col("Content")).alias("single"))


@register(f"""select LineId as "LineId", array_to_string(list_transform(regexp_extract_all(Content, '[^\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]+'),
    lambda p: case when regexp_matches(p, '[0-9]') then '<*>' else p end), '') as template from {v.URLS_SQL}""")
def heuristic_template(spark, sf_dir):
    return v.urls(spark, sf_dir).select("LineId", tx.heuristic_template(F.col("Content")).alias("template"))


@register(f"""select LineId as "LineId", regexp_replace(Content, '[0-9]+', '<*>', 'g') as template from {v.EVENTS_SQL}""")
def digit_fallback(spark, sf_dir):
    return v.events(spark, sf_dir).select("LineId", tx.digit_fallback(F.col("Content")).alias("template"))


_ANSWERS = """case LineId % 5 when 0 then concat('<START>', Content, '<END>') when 1 then concat('note <START>', Content)
    when 2 then concat('<START>no<END> then <START>', Content, '<END> yes') when 3 then concat(Content, '<END> Yes') else null end"""


@register(f"""with a as (select LineId, {_ANSWERS} as raw from {v.EVENTS_SQL}),
    b as (select LineId, raw, case when contains(raw, '<END>') then raw else raw || '<END>' end as ended from a),
    c as (select *, len(string_split(ended, '<START>')) = 2 and len(string_split(ended, '<END>')) = 2 as one from b)
    select LineId as "LineId", contains(lower(raw), 'yes') as yes,
        case when one then regexp_extract(ended, '<START>(.+)<END>', 1)
             else replace(list_filter(string_split(ended, '<START>'), lambda p: contains(p, '<END>'))[-1], '<END>', '') end as template from c""")
def unwrap_response(spark, sf_dir):
    """Answers of five shapes: what is between the tags, and whether they agree."""
    raw = F.expr(_ANSWERS)
    return v.events(spark, sf_dir).select("LineId", tx.is_yes(raw).alias("yes"), tx.unwrap_response(raw).alias("template"))


@register(f"""select LineId as "LineId", regexp_matches(regexp_replace(Content, case when LineId % 3 = 0 then '[^ ]+' else '[0-9]+' end, '<*>', 'g'), '[^<>* ]') as usable from {v.EVENTS_SQL}""")
def template_guard(spark, sf_dir):
    masked = F.expr("if(LineId % 3 = 0, regexp_replace(Content, '[^ ]+', '<*>'), regexp_replace(Content, '[0-9]+', '<*>'))")
    return v.events(spark, sf_dir).select("LineId", tx.has_constant(masked).alias("usable"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_prompt() -> str:
    shown = _sql_text(EXTRACT_EXAMPLE).replace("{content}", "' || content || '").replace("{template}", "' || template || '")
    whole = _sql_text(EXTRACT).replace("{examples}", "' || shown || '").replace("{log}", "' || Content || '")
    return f"""select LineId as "LineId", {whole} as prompt from {v.EVENTS_SQL} cross join
        (select string_agg({shown}, '' order by id) as shown from (select id, text as content, template from {v.PARTS_SQL} order by id limit 3))"""


@register(_sql_prompt())
def prompt_build(spark, sf_dir):
    """The extraction prompt of every event, with the first three parts as examples."""
    three = v.parts(spark, sf_dir).orderBy("id").limit(3)
    shown = three.agg(F.array_sort(F.collect_list(F.struct("id", F.col("text").alias("content"), "template"))).alias("examples"))
    return v.events(spark, sf_dir).crossJoin(shown).select("LineId", extract_prompt(F.col("Content"), F.col("examples")).alias("prompt"))  # one row


@register(f"""select LineId as "LineId", Content as "Content" from (select *, count(*) over () as n from {v.EVENTS_SQL}) where (LineId - 1) / n <= 0.2""")
def prefix_sample(spark, sf_dir):
    return rel.prefix_sample(v.events(spark, sf_dir).select("LineId", "Content"), 0.2)


# -- tokens and templates -------------------------------------------------------------

@register(f"""with m as (select LineId, case when LineId % 2 = 0 then regexp_replace(Content, '[0-9]+', '<*>', 'g') else regexp_replace(Content, '[0-9]+', '<*', 'g') end as t from {v.EVENTS_SQL}),
    u as (select LineId, regexp_extract_all(t, '(?s)<\\*>|<\\*|\\*>|.') as units from m)
    select LineId as "LineId", cast(len(units) as int) as n, array_to_string(list_transform(units, lambda p: case when p in ('<*', '*>') then '<*>' else p end), '~') as units from u""")
def char_units(spark, sf_dir):
    units = tx.char_units(F.expr("if(LineId % 2 = 0, regexp_replace(Content, '[0-9]+', '<*>'), regexp_replace(Content, '[0-9]+', '<*'))"))
    return v.events(spark, sf_dir).select("LineId", F.size(units).alias("n"), F.array_join(units, "~").alias("units"))


@register(f"""select LineId as "LineId", array_to_string(regexp_extract_all(Content, '<\\*>|[\\p{{L}}\\p{{N}}\\-_/.]+|(?s:.)'), '~') as units from {v.URLS_SQL}
    union all select -LineId, array_to_string(regexp_extract_all(regexp_replace(Content, '[0-9]+', '<*>', 'g'), '<\\*>|[\\p{{L}}\\p{{N}}\\-_/.]+|(?s:.)'), '~') from {v.EVENTS_SQL}""")
def word_units(spark, sf_dir):
    masked = v.events(spark, sf_dir).select((-F.col("LineId")).alias("LineId"), F.regexp_replace("Content", "[0-9]+", "<*>").alias("Content"))
    both = v.urls(spark, sf_dir).select("LineId", "Content").unionAll(masked)
    return both.select("LineId", F.array_join(tx.word_units(F.col("Content")), "~").alias("units"))


@register(f"""select LineId as "LineId", array_to_string(list_transform(regexp_extract_all(regexp_replace(Content, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'),
    '(?:\\p{{N}}+ )*\\p{{N}}*\\p{{L}}[\\p{{L}}\\p{{N}}]*'), lambda t: replace(t, ' ', '')), ' ') as tokens from {v.EVENTS_SQL}""")
def example_tokens(spark, sf_dir):
    return v.events(spark, sf_dir).select("LineId", F.array_join(tx.example_tokens(F.col("Content")), " ").alias("tokens"))


@register(f"""select id, i as pos, regexp_matches(u, '\\p{{L}}') as letter, regexp_matches(u, '[\\p{{L}}\\p{{N}}]') as alnum
    from (select id, unnest(string_split(text, ' ')) as u, generate_subscripts(string_split(text, ' '), 1) - 1 as i from {v.PARTS_SQL})""")
def char_predicates(spark, sf_dir):
    words = v.parts(spark, sf_dir).select("id", F.posexplode(F.split("text", " ", -1)).alias("pos", "u"))
    return words.select("id", F.col("pos").cast("long").alias("pos"), tx.has_letter(F.col("u")).alias("letter"), tx.has_alnum(F.col("u")).alias("alnum"))


@register(f"""select id, array_to_string(list_sort(list_distinct(list_concat(
    case when regexp_matches(p_brand, '[0-9]') then string_split('0123456789', '') else [] end,
    case when regexp_matches(p_brand, '\\p{{L}}') then string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '') else [] end,
    regexp_extract_all(p_brand, '[^\\p{{L}}0-9]')))), '') as chars from {v.PARTS_SQL}""")
def char_class(spark, sf_dir):
    return v.parts(spark, sf_dir).select("id", F.array_join(tx.char_class(F.col("p_brand")), "").alias("chars"))


def _next_parts(spark, sf_dir):
    """Each part beside the one with the next key."""
    parts = v.parts(spark, sf_dir).select("id", "text")
    return parts.join(parts.select((F.col("id") - 1).alias("id"), F.col("text").alias("other")), "id")


_NEXT_SQL = f"(select a.id, a.text, b.text as other from {v.PARTS_SQL} a join {v.PARTS_SQL} b on b.id = a.id + 1)"


@register(f"""with c as (select id, text as a, other as b, string_split(text, '') as x, string_split(other, '') as y from {_NEXT_SQL}),
    d as (select *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i] and x[i] <> '<'), false), least(len(x), len(y)) + 1) - 1 as h,
        coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[len(x) + 1 - i] = y[len(y) + 1 - i] and x[len(x) + 1 - i] <> '>'), false), least(len(x), len(y)) + 1) - 1 as t from c)
    select id, substr(a, h + 1, greatest(length(a) - h - t, 0)) as a, substr(b, h + 1, greatest(length(b) - h - t, 0)) as b from d""")
def strip_common(spark, sf_dir):
    return _next_parts(spark, sf_dir).select("id", tx.strip_common(F.col("text"), F.col("other")).alias("s")).select("id", "s.a", "s.b")


_MASKED = "regexp_replace(replace(Content, ' ', if(LineId % 3 = 0, ' ', ':')), '[0-9a-f]+', '<*>')"
_MASKED_SQL = "regexp_replace(replace(Content, ' ', case when LineId % 3 = 0 then ' ' else ':' end), '[0-9a-f]+', '<*>', 'g')"


@register(f"""select LineId as "LineId", regexp_replace(regexp_replace({_MASKED_SQL}, '<\\*>(?:[^\\p{{L}}\\p{{N}} ]*?<\\*>)+', '<*>', 'g'), '(?:<\\*>\\s){{10,}}<\\*>', '<*>', 'g') as template
    from (select LineId, concat(Content, ' ', repeat('7 ', cast(LineId % 14 as int)), '7') as Content from {v.EVENTS_SQL})""")
def merge_wilds(spark, sf_dir):
    long = v.events(spark, sf_dir).selectExpr("LineId", "concat(Content, ' ', repeat('7 ', cast(LineId % 14 as int)), '7') as Content")
    return long.select("LineId", tx.merge_wilds(F.expr(_MASKED)).alias("template"))


@register(f"""with recursive p as (select id, list_filter(string_split(text, ' '), lambda w: w <> '') as x, list_filter(string_split(other, ' '), lambda w: w <> '') as y from {_NEXT_SQL}),
    steps as (
        select id, x, y, 0 as i, list_transform(y, lambda w: 0) as prev from p
        union all
        select id, x, y, i + 1, list_reduce(list_prepend({{'l': 0, 'd': 0, 'k': 0, 'r': cast([] as int[])}}, list_transform(range(1, len(y) + 1), lambda k: {{'l': 0, 'd': 0, 'k': cast(k as int), 'r': cast([] as int[])}})),
            lambda s, e: {{'l': cast(case when y[e.k] = x[i + 1] or y[e.k] = '<*>' or x[i + 1] = '<*>' then s.d + 1 else greatest(s.l, prev[e.k]) end as int),
                          'd': cast(prev[e.k] as int), 'k': e.k,
                          'r': list_append(s.r, cast(case when y[e.k] = x[i + 1] or y[e.k] = '<*>' or x[i + 1] = '<*>' then s.d + 1 else greatest(s.l, prev[e.k]) end as int))}}).r
        from steps where i < len(x))
    select id, round(prev[-1] / greatest(len(x), len(y)), 6) as score from steps where i = len(x)""")
def lcs_similarity(spark, sf_dir):
    """Token similarity of consecutive parts."""
    return _next_parts(spark, sf_dir).select("id", F.round(tx.lcs_similarity(F.col("text"), F.col("other")), 6).alias("score"))


_PART_TEMPLATES = f"(select row_number() over (order by template) - 1 as tid, template from (select distinct template from {v.PARTS_SQL}))"


def _part_templates(spark, sf_dir):
    """tid and template, numbered in order."""
    return rel.renumber(v.parts(spark, sf_dir).select("template").distinct(), "template", "tid").select(F.col("tid").cast("long").alias("tid"), "template")


@register(f"""with t as (select tid, '^' || replace(replace(regexp_replace(template, '([\\\\()\\[\\]{{}}.+?|^$])', '\\\\\\1', 'g'), '<*>', '(.+)'), '*', '\\*') || '$' as re from {_PART_TEMPLATES})
    select p.id, min(t.tid) as tid from {v.PARTS_SQL} p join t on regexp_matches(p.text, t.re) group by p.id""")
def template_regex_match(spark, sf_dir):
    """The first template whose expression matches each part."""
    return regex_match(v.parts(spark, sf_dir).select("id", "text"), _part_templates(spark, sf_dir))


@register(f"select id, cast(levenshtein(text, other) as int) as distance from {_NEXT_SQL}")
def edit_distance(spark, sf_dir):
    return _next_parts(spark, sf_dir).select("id", F.levenshtein("text", "other").alias("distance"))


# -- masks and correction ---------------------------------------------------------------

_RAW = "concat(Content, ' at 10.0.', LineId % 256, '.7 mac ab:cd:0', LineId % 10, ':ff ptr 0x', lower(hex(LineId)), ' -', LineId, ', +3')"
_RAW_SQL = "concat(Content, ' at 10.0.', cast(LineId % 256 as varchar), '.7 mac ab:cd:0', cast(LineId % 10 as varchar), ':ff ptr 0x', lower(to_hex(LineId)), ' -', cast(LineId as varchar), ', +3')"


def _mask_sql(text: str) -> str:
    """The masks for a dialect without lookaround: boundary characters are kept by reference, and every rule runs twice."""
    bodies = [
        "(?:[0-9a-f]{2,}:){3,}[0-9a-f]{2,}",
        "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}",
        "(?:[0-9a-f]{6,} ?){3,}",
        "(?:[0-9A-F]{4} ?){4,}",
        "0x[a-f0-9A-F]+",
        "[-+]?[0-9]+",
    ]
    for body in bodies:
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^A-Za-z0-9]){body}($|[^A-Za-z0-9])', '\\1<*>\\2', 'g')"
    return text


@register(f"""select LineId as "LineId", {_mask_sql(_RAW_SQL)} as masked from {v.EVENTS_SQL}
    union all select LineId, {_mask_sql('Content')} from {v.ITEMS_SQL}""")
def mask_common_rules(spark, sf_dir):
    """All masks over events with addresses and pointers, and over the largest table."""
    both = v.events(spark, sf_dir).selectExpr("LineId", f"{_RAW} as Content").unionAll(v.items(spark, sf_dir).select("LineId", "Content"))
    return both.select("LineId", mask_common(F.col("Content")).alias("masked"))


QUERIES["mask_common"], ORACLE["mask_common"] = QUERIES.pop("mask_common_rules"), ORACLE.pop("mask_common_rules")


@register(f"""select LineId as "LineId", trim(regexp_replace({_SPACED_SQL}, '\\s+', ' ', 'g')) as template from
    (select LineId, regexp_replace(Content, '[0-9]+', '<*>', 'g') as Content from {v.EVENTS_SQL})""")
def post_spaces(spark, sf_dir):
    masked = v.events(spark, sf_dir).select("LineId", F.regexp_replace("Content", "[0-9]+", "<*>").alias("Content"))
    return masked.select("LineId", tx.normalize_ws(F.expr(_SPACED)).alias("template"))


_PATHS = "concat('open=', regexp_replace(Content, '^https?:/', ''), ', (/var/log/x.', LineId, '/) /a//b')"
_PATHS_SQL = "concat('open=', regexp_replace(Content, '^https?:/', ''), ', (/var/log/x.', cast(LineId as varchar), '/) /a//b')"
_D_PATH = r"""\s,!;:=|"''\[\](){}"""
_D_TOKEN = _D_PATH + r".\-+@#$%&"


def _token_sql(text: str, delimiters: str, pattern: str) -> str:
    parts = f"regexp_extract_all({text}, '[{delimiters}]|[^{delimiters}]+')"
    return f"array_to_string(list_transform({parts}, lambda p: case when regexp_matches(p, '{pattern}') then '<*>' else p end), '')"


@register(f"""select LineId as "LineId", {_token_sql(_PATHS_SQL, _D_PATH, '^(/[^/]+)+/?$')} as template from {v.URLS_SQL}""")
def post_paths(spark, sf_dir):
    return v.urls(spark, sf_dir).select("LineId", mask_paths(F.expr(_PATHS)).alias("template"))


@register(f"""select LineId as "LineId", {_token_sql('Content', _D_TOKEN, '^[0-9]+$')} as template from
    (select LineId, Content from {v.URLS_SQL} union all select -o_orderkey - 1, value from {v.ORDERS_SQL})""")
def post_digits(spark, sf_dir):
    orders = v.orders_lines(spark, sf_dir).selectExpr("-o_orderkey - 1", "value")
    return v.urls(spark, sf_dir).unionAll(orders).select("LineId", mask_digits(F.col("Content")).alias("template"))


@register(f"""select LineId as "LineId", {_token_sql("regexp_replace(Content, '[0-9]', '<*>', 'g')", _D_TOKEN, '^[^ /]*<\\*>[^ /]*$')} as template from
    (select LineId, Content from {v.URLS_SQL} union all select -o_orderkey - 1, value from {v.ORDERS_SQL})""")
def post_word_var(spark, sf_dir):
    orders = v.orders_lines(spark, sf_dir).selectExpr("-o_orderkey - 1", "value")
    masked = F.regexp_replace("Content", "[0-9]", "<*>")
    return v.urls(spark, sf_dir).unionAll(orders).select("LineId", mask_word_variables(masked).alias("template"))


_CROWDED = "concat('a #<*># ', regexp_replace(Content, '[a-z0-9]+', '<*>'), ' #<*> #<*> \"<*>\" \"<*>\" ', repeat('<*>', cast(LineId % 4 as int)), '<*>.<*>:<*>/<*>@<*>#<*> z')"
_CROWDED_SQL = "concat('a #<*># ', regexp_replace(Content, '[a-z0-9]+', '<*>', 'g'), ' #<*> #<*> \"<*>\" \"<*>\" ', repeat('<*>', cast(LineId % 4 as int)), '<*>.<*>:<*>/<*>@<*>#<*> z')"


def _collapse_sql(text: str) -> str:
    chain = lambda t, x: f"regexp_replace({t}, '<\\*>(?:{x}<\\*>)+', '<*>', 'g')"
    twice = lambda t, a: f"replace(replace({t}, ' {a} ', ' <*> '), ' {a} ', ' <*> ')"
    text = twice(twice(chain(chain(text, "\\."), ""), "#<*>#"), "#<*>")
    for x in (":", "#", "/", "@", "\\."):
        text = chain(text, x)
    return chain(twice(twice(text, '"<*>"'), "''<*>''"), "")


@register(f"""select LineId as "LineId", {_collapse_sql(_CROWDED_SQL)} as template from {v.EVENTS_SQL}""")
def post_collapse(spark, sf_dir):
    return v.events(spark, sf_dir).select("LineId", collapse(F.expr(_CROWDED)).alias("template"))


# -- ground truth, counts, ids --------------------------------------------------------------

_TEMPLATE_SQL = "regexp_replace(Content, '[0-9]+', '<*>', 'g')"


def _templated(spark, sf_dir):
    """Events with EventTemplate, their digits masked."""
    return v.events(spark, sf_dir).withColumn("EventTemplate", tx.digit_fallback(F.col("Content")))


_TRUTH_SQL = f"""with lines as (select LineId, Content, case when event_type = 'error' then 'NO_TEMPLATE_FOUND' else {_TEMPLATE_SQL} end as template from {v.EVENTS_SQL}),
    ids as (select template, 'E' || cast(row_number() over (order by min(LineId)) as varchar) as event from lines group by template)"""


@register(_TRUTH_SQL + """ select LineId as "LineId", Content as "Content", event as "EventId", template as "EventTemplate" from lines join ids using (template)""")
def ground_truth_build(spark, sf_dir):
    """Truth from annotations of all events but errors; the first annotation of each content is overridden."""
    lines = _templated(spark, sf_dir)
    notes = lines.where("event_type <> 'error'").select("Content", "EventTemplate", F.lit(1).alias("pos"))
    wrong = notes.select("Content", F.lit("wrong").alias("EventTemplate"), F.lit(0).alias("pos"))
    return build_groundtruth(lines.select("LineId", "Content"), wrong.union(notes))[0]


@register(f"""select e.LineId as "LineId", case when e.event_type = 'view' then -1 else t.n end as "EventId", case when e.event_type = 'view' then '' else e.event_type end as "EventTemplate"
    from {v.EVENTS_SQL} e left join (select event_type, row_number() over (order by event_type) - 1 as n from (select distinct event_type from events where event_type <> 'view')) t using (event_type)""")
def assign_events_to_lines(spark, sf_dir):
    lines = v.events(spark, sf_dir)
    clusters = rel.renumber(lines.where("event_type <> 'view'").select(F.col("event_type").alias("EventTemplate")).distinct(), "EventTemplate", "EventId")
    clusters = clusters.select(F.col("EventId").cast("long").alias("cid"), F.col("EventId").cast("long").alias("EventId"), "EventTemplate")
    members = lines.join(clusters.select("cid", F.col("EventTemplate").alias("event_type")), "event_type").select("LineId", "cid")
    return assign_events(lines.select("LineId"), members, clusters)


QUERIES["assign_events"], ORACLE["assign_events"] = QUERIES.pop("assign_events_to_lines"), ORACLE.pop("assign_events_to_lines")


@register("""with recursive r as (select p_partkey as cid, p_partkey as root from part
    union all select cid, root // 2 from r where root > 0) select cid, min(root) as root from r group by cid""")
def redirect_roots(spark, sf_dir):
    """The last redirect of chains in which every part's key points to its half."""
    links = v.table(spark, sf_dir, "part").selectExpr("p_partkey as cid", "p_partkey div 2 as next")
    return rel.roots(links)


_LIVE_SQL = f"(select template, min(id) as live from {v.PARTS_SQL} group by template)"


@register(f"select live, template, row_number() over (order by live) - 1 as cid from {_LIVE_SQL}")
def renumber_clusters(spark, sf_dir):
    """Templates of parts, known by their first part, numbered without gaps."""
    live = v.parts(spark, sf_dir).groupBy("template").agg(F.min("id").alias("live"))
    return rel.renumber(live, "live", "cid").withColumn("cid", F.col("cid").cast("long"))


@register(f"""with t as (select {_TEMPLATE_SQL} as template, min(LineId) as first, count(*) as n from {v.EVENTS_SQL} group by 1)
    select 'E' || cast(row_number() over (order by first) as varchar) as "EventId", template as "EventTemplate", n as "Occurrences" from t""")
def template_counts_by_event(spark, sf_dir):
    """Which templates occur and how often."""
    lines = _templated(spark, sf_dir)
    events = event_ids(lines)
    return template_counts(lines.join(events.drop("Occurrences"), "EventTemplate"))


QUERIES["template_counts"], ORACLE["template_counts"] = QUERIES.pop("template_counts_by_event"), ORACLE.pop("template_counts_by_event")


@register(f"""with t as (select {_TEMPLATE_SQL} as template from {v.EVENTS_SQL} group by 1),
    known as (select template, row_number() over (order by template) - 1 as cid from t where template < 'purchase'),
    fresh as (select template, row_number() over (order by template) as n from t where template >= 'purchase')
    select template, cid, false as is_new from known union all select template, (select max(cid) from known) + n, true from fresh""")
def template_upsert_batch(spark, sf_dir):
    """A batch of templates against a store that holds some of them."""
    new = _templated(spark, sf_dir).select(F.col("EventTemplate").alias("template"))
    known = rel.renumber(new.where("template < 'purchase'").distinct(), "template", "cid").withColumn("cid", F.col("cid").cast("long"))
    return template_upsert(known, new)


QUERIES["template_upsert"], ORACLE["template_upsert"] = QUERIES.pop("template_upsert_batch"), ORACLE.pop("template_upsert_batch")


# -- similarity ---------------------------------------------------------------------------

_WORDS_SQL = "regexp_extract_all({}, '<\\*>|[\\p{{L}}\\p{{N}}\\-_/.]+|(?s:.)')"
_ALPHA_SQL = "list_filter(" + _WORDS_SQL + ", lambda t: regexp_matches(t, '^\\p{{L}}+$'))"
_LETTERED_SQL = "list_filter(" + _WORDS_SQL + ", lambda t: regexp_matches(t, '[a-zA-Z]'))"


def _index_sql(view: str, key: str, text: str) -> str:
    return f"(select {key}, token, count(*) as cnt from (select {key}, unnest({_ALPHA_SQL.format(text)}) as token from {view}) group by all)"


@register(f"select id, token, cnt from {_index_sql(v.PARTS_SQL, 'id', 'text')}")
def token_index(spark, sf_dir):
    return similarity.token_index(v.parts(spark, sf_dir), "id", "text")


_LABELS_SQL = "(select row_number() over (order by template) - 1 as tid, template from (select distinct concat(p_name, ' / ', p_type) as template from part))"


@register(f"""with m as {_index_sql(v.PARTS_SQL, 'id', 'text')}, t as {_index_sql(_LABELS_SQL, 'tid', 'template')},
    c as (select m.id, t.tid, sum(least(m.cnt, t.cnt)) as common from m join t using (token) group by all),
    s as (select id, tid, round(2 * common / ((select sum(cnt) from m m2 where m2.id = c.id) + (select sum(cnt) from t t2 where t2.tid = c.tid)), 6) as score from c)
    select id, tid, score, 1 as rank from (select *, row_number() over (partition by id order by score desc, tid) as r from s) where r = 1""")
def nearest_template(spark, sf_dir):
    """The most similar label of every part."""
    labels = v.parts(spark, sf_dir).select(F.concat_ws(" / ", "p_name", "p_type").alias("template")).distinct()
    labels = rel.renumber(labels, "template", "tid").select(F.col("tid").cast("long").alias("tid"), F.col("template").alias("text"))
    return similarity.nearest_template(v.parts(spark, sf_dir), labels)


@register(f"""with m as (select id, {_LETTERED_SQL.format('text')} as tokens from {v.PARTS_SQL}), p as (select live as pid, {_LETTERED_SQL.format('template')} as toks from {_LIVE_SQL}),
    w as (select id, len(tokens) as n, unnest(tokens) as token from m), q as (select pid, len(toks) as pn, unnest(list_distinct(toks)) as token from p),
    s as (select id, pid, round(count(*) / ((n + pn) // 2), 6) as score from w join q using (token) group by id, pid, n, pn)
    select id, arg_min(pid, -score * 1000000000 + pid) as pid, max(score) as score from s group by id""")
def pending_similarity(spark, sf_dir):
    """The most similar pending message for every part; each template of parts is pending, known by its first part."""
    parts = v.parts(spark, sf_dir)
    pending = parts.groupBy("template").agg(F.min("id").alias("pid")).select("pid", F.col("template").alias("text"))
    return similarity.pending_similarity(parts.select("id", "text"), pending)


@register(f"""with a as (select id, unnest(list_distinct({_ALPHA_SQL.format('text')})) as token from {v.PARTS_SQL}),
    p as (select a.id, a.token, b.token as other from a left join a b on b.id = a.id + 1 and b.token = a.token)
    select x.id, x.n_union, coalesce(y.n_common, 0) as n_common from
    (select a.id, count(distinct t.token) as n_union from (select distinct id from a) a join a t on t.id in (a.id, a.id + 1) group by a.id) x
    left join (select id, count(other) as n_common from p group by id) y using (id)""")
def token_set_ops(spark, sf_dir):
    """Size of the union and of the intersection of the tokens of consecutive parts."""
    index = similarity.token_index(v.parts(spark, sf_dir), "id", "text").select("id", "token")
    both = index.withColumn("side", F.lit(1)).unionAll(index.select((F.col("id") - 1).alias("id"), "token", F.lit(2).alias("side")))
    sets = both.groupBy("id", "token").agg(F.sum("side").alias("sides")).where("id >= 0")
    return sets.groupBy("id").agg(F.count("*").alias("n_union"), F.count_if(F.col("sides") == 3).alias("n_common")).join(index.select("id").distinct(), "id", "left_semi")


def _examples(spark, sf_dir):
    """A seeded sample of thirty-two parts as examples; the brand is variable."""
    drawn = rel.hash_sample(v.parts(spark, sf_dir), 32, "id")
    return drawn.select("id", "text", "template", F.array("p_brand").alias("contents"))


def _drawn_sql(view: str, n: int, key: str, seed: int = 0) -> str:
    return f"(select * from {view} order by md5('{seed}:' || cast({key} as varchar)), {key} limit {n})"


_TOK_SQL = "list_transform(regexp_extract_all(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '(?:\\p{{N}}+ )*\\p{{N}}*\\p{{L}}[\\p{{L}}\\p{{N}}]*'), lambda t: replace(t, ' ', ''))"
_EXAMPLES_SQL = f"""e as (select id, template, p_brand from {_drawn_sql(v.PARTS_SQL, 32, 'id')}),
    c as (select id, unnest(list_distinct({_TOK_SQL.format('template')})) as token from e),
    d as (select id, unnest(list_distinct({_TOK_SQL.format('p_brand')})) as token from e),
    per as (select id, token, sum(c) as c, sum(d) as d from (select id, token, 1 as c, 0 as d from c union all select id, token, 0, 1 from d) group by all),
    tot as (select token, sum(c) as cs, sum(d) as ds from per group by token),
    idx as (select id as cand_id, token, cast(c + d as bigint) as times, least(cs, ds) / greatest(cs, ds) + 1 as weight from per join tot using (token))"""


@register(f"with {_EXAMPLES_SQL} select cand_id, token, times, round(weight, 6) as weight from idx")
def example_index(spark, sf_dir):
    return similarity.example_index(_examples(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@register(f"""with {_EXAMPLES_SQL}, w as (select id, unnest({_TOK_SQL.format('text')}) as token from {v.PARTS_SQL}),
    self as (select id, sum(coalesce(weight, 1.0)) as own from w left join (select distinct token, weight from idx) using (token) group by id),
    total as (select cand_id, sum(times * weight) as total from idx group by cand_id),
    sh as (select id, cand_id, sum(times * weight) as s from w join idx using (token) group by all),
    sims as (select self.id, total.cand_id, round(coalesce(s, 0) / (own + total - coalesce(s, 0)), 6) as sim from self cross join total left join sh on sh.id = self.id and sh.cand_id = total.cand_id)
    select id, cand_id, sim, cast(r as int) as rank from (select *, row_number() over (partition by id order by sim desc, cand_id) as r from sims) where r <= 3""")
def example_knn(spark, sf_dir):
    """The three nearest examples of every part."""
    return similarity.example_knn(v.parts(spark, sf_dir).select("id", "text"), similarity.example_index(_examples(spark, sf_dir)))


# -- sampling -------------------------------------------------------------------------------

_RE_SQL = "'^' || replace(replace(regexp_replace({}, '([\\\\()\\[\\]{{}}.+?|^$])', '\\\\\\1', 'g'), '<*>', '(.+)'), '*', '\\*') || '$'"
_NEAR_SQL = f"""n as (select a.id, b.id as n_id, levenshtein(a.text, b.text) as distance, a.template = b.template as same, regexp_matches(b.text, a.re) as fits
    from (select *, {_RE_SQL.format('template')} as re from {v.PARTS_SQL}) a join {v.PARTS_SQL} b on b.id <> a.id
    and (b.id between a.id - 50 and a.id + 50 or b.id in (select id from {_drawn_sql(v.PARTS_SQL, 32, 'id')})))"""


def _near_pairs(spark, sf_dir):
    """Every part beside those up to 50 places away and 32 drawn ones."""
    parts = v.parts(spark, sf_dir).select("id", "text", "template")
    return sampling.pairs_near(parts, parts, reach=50, extra=32)


@register(f"select a.id, b.id as n_id from {v.PARTS_SQL} a join {v.PARTS_SQL} b on b.id <> a.id and b.id between a.id - 50 and a.id + 50")
def neighbourhood(spark, sf_dir):
    """The band join on row places."""
    parts = v.parts(spark, sf_dir).select("id")
    return rel.neighbourhood(parts, parts, "id", 50)


@register(f"with {_NEAR_SQL} select id, arg_min(n_id, distance * 100000000 + n_id) as n_id from n where not same and not fits group by id")
def hard_negative(spark, sf_dir):
    """Every part's nearest of another template, of those up to 50 places away and 32 drawn ones."""
    parts = v.parts(spark, sf_dir).select("id", "text", "template")
    return sampling.hard_negatives_near(parts, parts, reach=50, extra=32)


@register(f"with {_NEAR_SQL} select id, arg_max(n_id, distance * 100000000 - n_id) as n_id from n where same and fits group by id")
def hard_positive(spark, sf_dir):
    return sampling.hard_positives(_near_pairs(spark, sf_dir))


def _farthest_sql(steps: int) -> str:
    """The greedy choice unrolled over the pool."""
    lines = f"(select LineId, Content, count(*) over () as n from {v.EVENTS_SQL})"
    drawn = _drawn_sql(f"(select LineId as id, Content as text from {lines} where (LineId - 1) / n <= 0.2)", 1024, "id", 3)
    sql = f"with pool as materialized {drawn}, s0 as (select id, text, {1 << 30} as d, (select min(id) from pool) as pick from pool)"
    for k in range(1, steps):
        last = f"s{k - 1}"
        sql += f""", u{k} as (select id, text, least(d, levenshtein(text, (select text from {last} where id = pick limit 1))) as d from {last}),
            s{k} as (select *, (select id from u{k} where d > 0 order by d desc, id limit 1) as pick from u{k})"""
    return sql + " " + " union all ".join(f"select distinct cast({k + 1} as int) as step, pick as id from s{k}" for k in range(steps))


@register(_farthest_sql(6))
def farthest_point(spark, sf_dir):
    """Six lines of a pool of 1,024 events, each the farthest from those before it."""
    pool = sampling.example_pool(v.events(spark, sf_dir), 0.2, 1024, seed=3)
    chosen = sampling.farthest_points(pool.select(F.col("LineId").alias("id"), F.col("Content").alias("text")), 6)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(chosen)], "step int, id long")


@register(f"""select LineId as "LineId", Content as "Content" from {_drawn_sql(v.EVENTS_SQL, 32, 'LineId', 7)}""")
def hash_sample(spark, sf_dir):
    """A repeatable sample of 32 events."""
    return rel.hash_sample(v.events(spark, sf_dir).select("LineId", "Content"), 32, "LineId", seed=7)


@register()
def synth_positive(spark, sf_dir):
    """Parts with other digits in their variable."""
    return v.parts(spark, sf_dir).select("id", "text", sampling.synth_positive_udf("template", "text", "id").alias("positive"))


# -- accuracy -------------------------------------------------------------------------------

_PARSED = "case when event_type = 'error' then if(value > 100, 'error high', 'error low') when event_type in ('click', 'view') then 'click or view' else event_type end"
_PARSED_SQL = "case when event_type = 'error' then case when value > 100 then 'error high' else 'error low' end when event_type in ('click', 'view') then 'click or view' else event_type end"
#: Lines of small values have no truth.
_TRUE = "case when value >= 2 then event_type end"
# Templates of the exact groups: sign-ups have a listed pair, purchases differ, others are equal after rewriting.
_TRUE_NAME = "case {0} when 'signup' then 'session opened for user <*> by <*>' when 'purchase' then 'purchase of <*>' else concat({0}, ' (<*>)') end"
_PARSED_NAME = "case {0} when 'signup' then 'session opened for user <*> by <*>(uid=<*>)' when 'purchase' then 'bought <*>' else concat({0}, ' <*>') end"


def _truth_and_parse(spark, sf_dir):
    """Truth by event type, with nulls; a parse that splits one type and joins two others; their template tables."""
    lines = v.events(spark, sf_dir)
    truth = lines.select("LineId", F.expr(_TRUE).alias("EventId"))
    parsed = lines.select("LineId", F.expr(_PARSED).alias("EventId"))
    own = lambda df, name: df.where("EventId is not null").select("EventId").distinct().withColumn("EventTemplate", F.expr(name.format("EventId")))
    return truth, parsed, own(truth, _TRUE_NAME), own(parsed, _PARSED_NAME)


def _truth_twice(spark, sf_dir):
    """The truth as a parse of itself, with other names and equivalent templates."""
    truth, _, names, _ = _truth_and_parse(spark, sf_dir)
    parsed = truth.withColumn("EventId", F.concat(F.lit("p "), "EventId"))
    return truth, parsed, names, names.select(F.concat(F.lit("p "), "EventId").alias("EventId"), F.replace("EventTemplate", F.lit("<*>"), F.lit('"<*>"')).alias("EventTemplate"))


_EVAL_SQL = f"""with l as (select LineId, {_TRUE} as t, {_PARSED_SQL} as p from {v.EVENTS_SQL} where value >= 2),
    n as (select t, p, count(*) as n from l group by all),
    x as (select t, p, n from n where n = (select sum(n) from n a where a.t = n.t) and n = (select sum(n) from n b where b.p = n.p)),
    g as (select coalesce((select sum(n) from x), 0) / (select count(*) from l) as ga, (select count(*) from x) / (select count(distinct p) from l) as pga,
        (select count(*) from x) / (select count(distinct t) from l) as rga),
    y as (select t, n from (select *, {_TRUE_NAME.format('t')} as a, {_PARSED_NAME.format('p')} as b from x)
        where (a = 'session opened for user <*> by <*>' and b = 'session opened for user <*> by <*>(uid=<*>)') or replace(replace(a, '(', ''), ')', '') = b),
    k as (select coalesce((select sum(n) from y), 0) / (select count(*) from l) as pa, (select count(*) from y) / (select count(distinct p) from l) as pta,
        (select count(*) from y) / (select count(distinct t) from l) as rta)"""


@register(_EVAL_SQL + """ select round(ga, 6) as "GA", round(pga, 6) as "PGA", round(rga, 6) as "RGA" from g""")
def eval_grouping(spark, sf_dir):
    truth, parsed, *_ = _truth_and_parse(spark, sf_dir)
    return ev.grouping_accuracy(truth, parsed).select(*(F.round(c, 6).alias(c) for c in ("GA", "PGA", "RGA")))


@register(_EVAL_SQL + """ select round(pa, 6) as "PA", round(pta, 6) as "PTA", round(rta, 6) as "RTA" from k""")
def eval_templates(spark, sf_dir):
    return ev.template_accuracy(*_truth_and_parse(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("PA", "PTA", "RTA")))


@register(_EVAL_SQL + """ select round(ga, 6) as "GA", round(pga, 6) as "PGA", round(rga, 6) as "RGA", round(2 * pga * rga / (pga + rga), 6) as "FGA",
    round(pa, 6) as "PA", round(pta, 6) as "PTA", round(rta, 6) as "RTA", round(2 * pta * rta / (pta + rta), 6) as "FTA" from g, k""")
def eval_summary(spark, sf_dir):
    found = ev.evaluate(*_truth_and_parse(spark, sf_dir))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


# The second data set is the truth itself, its templates equal after rewriting.
@register(_EVAL_SQL + """, m as (select 'GA' as metric, round(ga, 6) as value, 1.0 as own from g union all select 'FGA', round(2 * pga * rga / (pga + rga), 6), 1.0 from g
    union all select 'PA', round(pa, 6), 1.0 from k union all select 'FTA', round(2 * pta * rta / (pta + rta), 6), 1.0 from k)
    select metric, value as "events", cast(own as double) as "truth" from m""")
def benchmark_pivot(spark, sf_dir):
    """Metrics as rows and data sets as columns."""
    scores = lambda rows, name: ev.evaluate(*rows).select(F.lit(name).alias("Dataset"), *(F.round(c, 6).alias(c) for c in ("GA", "FGA", "PA", "FTA")))
    return transposed(scores(_truth_and_parse(spark, sf_dir), "events").unionAll(scores(_truth_twice(spark, sf_dir), "truth")))


@register(f"""select date_trunc('day', ts)::timestamp as window_start, {_TEMPLATE_SQL} as "EventTemplate", count(*) as "Occurrences" from {v.EVENTS_SQL} group by 1, 2""")
def windowed_template_counts(spark, sf_dir):
    return windowed_counts(_templated(spark, sf_dir))


# -- alignment, trie and engine ---------------------------------------------------------------


@register()
def wild_align(spark, sf_dir):
    """Events fitted to their masked templates, with the wildcards' contents."""
    lines = _templated(spark, sf_dir).select("LineId", "EventTemplate", "Content")
    return lines.select("LineId", wild_align_udf("EventTemplate", "Content").alias("a")).select(
        "LineId", "a.template", F.array_join("a.contents", "|").alias("contents"), F.size("a.classes").alias("n")
    )


@register()
def merge_templates(spark, sf_dir):
    """Consecutive parts merged."""
    return _next_parts(spark, sf_dir).select("id", merge_templates_udf("text", "other").alias("m")).select("id", "m.template", F.size("m.gaps").alias("gaps"))


@register()
def cover_join(spark, sf_dir):
    """Which texts and templates of parts cover each other."""
    parts = v.parts(spark, sf_dir)
    both = parts.select("template").union(parts.select("text")).distinct()
    return cover_pairs(rel.renumber(both, "template", "tid"))


@register(ORACLE["template_counts"])
def trie_match_counts(spark, sf_dir):
    """Events matched by the trie of their templates: counts equal those of masking."""
    lines = _templated(spark, sf_dir)
    events = lines.groupBy("EventTemplate").agg(F.min("LineId").alias("first"), F.min_by("Content", "LineId").alias("Content"), F.count("*").alias("n"))
    known = events.select("EventTemplate", "first", wild_align_udf("EventTemplate", "Content")["contents"].alias("contents")).orderBy("first").collect()  # a row a template
    trie = build([(k + 1, r.EventTemplate, r.contents) for k, r in enumerate(known)])
    messages = lines.groupBy("Content").agg(F.count("*").alias("n"))
    found = trie_match(messages, trie, "Content")
    names = spark.createDataFrame([(k + 1, r.EventTemplate) for k, r in enumerate(known)], "cid long, EventTemplate string")
    counts = found.groupBy("cid").agg(F.sum("n").alias("Occurrences")).join(names, "cid")
    return counts.select(F.concat(F.lit("E"), F.col("cid").cast("string")).alias("EventId"), "EventTemplate", "Occurrences")


QUERIES["trie_match"], ORACLE["trie_match"] = QUERIES.pop("trie_match_counts"), ORACLE.pop("trie_match_counts")


@register()
def online_parse(spark, sf_dir):
    """Events mined without any truth: EventTemplate and Occurrences."""
    mined = Miner().mine(v.events(spark, sf_dir).select("LineId", "Content"))
    return mined.groupBy("EventTemplate").agg(F.count("*").alias("Occurrences"))


_FRAMED = ["[{}]", "({})", "{{ {} }}", "'{}'", "\"{}\"", "{}:", "{}.", "{} KB", "BP-{}", "x.{}", "..{}", "+{}", "{}-{}", "{};", "#{}", "http://{}"]


def _framed(sql: bool) -> str:
    """Text of a part's template whose wildcards stand in one of the frames, two deep, by name and type."""
    text = "replace(template, ' / ', ' <*> ')"
    for column, at in (("p_name", 2), ("p_type", 1)):
        pick = f"length({column}) % {len(_FRAMED)}" if at == 1 else f"(length({column}) * 7 + ascii({column})) % {len(_FRAMED)}"
        quote = lambda x: "'" + x.format("<*>", "<*>").replace("'", "''" if sql else "\\'") + "'"
        cases = " ".join(f"when {k} then {quote(f)}" for k, f in enumerate(_FRAMED))
        text = f"replace({text}, '<*>', case {pick} {cases} end)"
    return text


def _rewrites_sql() -> str:
    """The rewrites in order, each four times, a step a subquery."""
    sql = f"(select distinct {_framed(True)} as t, {_framed(True)} as r from {v.PARTS_SQL})"
    for pattern, to in REWRITES:
        rule = pattern.replace("'", "''")
        once = lambda x: f"regexp_replace({x}, '{rule}', '{to}', 'g')"  # noqa: E731, B023
        sql = f"(select t, {once(once(once(once('r'))))} as r from {sql})"
    return f'select t as "EventTemplate", r as rewritten from {sql}'


@register(_rewrites_sql())
def template_rewrites(spark, sf_dir):
    """Templates before and after the rewriting that precedes comparison."""
    framed = v.parts(spark, sf_dir).select(F.expr(_framed(False)).alias("EventTemplate")).distinct()
    return framed.withColumn("rewritten", rewritten("EventTemplate"))


# -- whole chains, readers and writers ------------------------------------------------------------


def _corrected_sql() -> str:
    """The steps of correction, a step a subquery."""
    steps = [
        _mask_sql("c"),
        "trim(regexp_replace(c, '\\s+', ' ', 'g'))",
        _token_sql("c", _D_PATH, "^(/[^/]+)+/?$"),
        _token_sql("c", _D_TOKEN, "^[0-9]+$"),
        _token_sql("c", _D_TOKEN, "^[^ /]*<\\*>[^ /]*$"),
        _collapse_sql("c"),
    ]
    sql = f"(select LineId, {_RAW_SQL} || ', /var/log/x.1 #7# v=9.8:7' as c from {v.EVENTS_SQL} union all select -LineId, Content from {v.URLS_SQL})"
    for step in steps:
        sql = f"(select LineId, {step} as c from {sql})"
    return f'select LineId as "LineId", c as template from {sql}'


@register(_corrected_sql())
def template_correction(spark, sf_dir):
    """The whole correction over events with addresses, pointers and paths, and over web addresses."""
    events = v.events(spark, sf_dir).selectExpr("LineId", f"{_RAW} || ', /var/log/x.1 #7# v=9.8:7' as Content")
    both = events.unionAll(v.urls(spark, sf_dir).selectExpr("-LineId", "Content"))
    return both.select("LineId", correct_template(F.col("Content")).alias("template"))


def _sql_merge_prompt() -> str:
    example = lambda other, answer: _sql_text(MERGE_EXAMPLE.replace("{answer}", answer)).replace("{content}", "' || content || '").replace("{other}", f"' || {other} || '")
    shown = f"{example('positive', 'Yes')} || {example('negative', 'No')}"
    whole = _sql_text(MERGE).replace("{examples}", "' || shown || '").replace("{log1}", "' || Content || '").replace("{log2}", "' || template || '")
    return f"""select LineId as "LineId", {whole} as prompt from (select LineId, Content, {_TEMPLATE_SQL} as template from {v.EVENTS_SQL}) cross join
        (select string_agg({shown}, '' order by id) as shown from (select id, text as content, replace(text, '#', '#0') as positive, p_type as negative from {v.PARTS_SQL} order by id limit 3))"""


@register(_sql_merge_prompt())
def merge_prompt_build(spark, sf_dir):
    """The merge prompt of every event and its template, with the first three parts as examples."""
    three = v.parts(spark, sf_dir).orderBy("id").limit(3)
    fields = F.struct("id", F.col("text").alias("content"), F.replace("text", F.lit("#"), F.lit("#0")).alias("positive"), F.col("p_type").alias("negative"))
    shown = three.agg(F.array_sort(F.collect_list(fields)).alias("examples"))
    lines = _templated(spark, sf_dir).crossJoin(shown)  # one row
    return lines.select("LineId", merge_prompt(F.col("Content"), F.col("EventTemplate"), F.col("examples")).alias("prompt"))


def _folder(spark, label: str) -> str:
    return new_path(spark, f"query-{label}")


_LOG_SQL = f"""select row_number() over (order by o_orderkey) as "LineId", regexp_extract(value, '{_ORDER_RE}', 1) as "Date", regexp_extract(value, '{_ORDER_RE}', 2) as "Status",
    regexp_extract(value, '{_ORDER_RE}', 3) as "Order", regexp_extract(value, '{_ORDER_RE}', 4) as "Content" from {v.ORDERS_SQL} where regexp_matches(value, '{_ORDER_RE}')"""


def _written_log(spark, sf_dir) -> str:
    """Orders as text files, whose names follow the order of the keys; lines have spaces around them."""
    path = _folder(spark, "log")
    lines = v.orders_lines(spark, sf_dir).repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey")
    lines.select(F.concat(F.lit("  "), "value", F.lit("\t"))).write.text(path)
    return path


@register(_LOG_SQL)
def log_reader(spark, sf_dir):
    """A log written as text files and loaded by its format."""
    return readers.load_log(spark, _written_log(spark, sf_dir), v.ORDER_FORMAT)


@register(_LOG_SQL + " order by o_orderkey limit 2000")
def log_sample_reader(spark, sf_dir):
    """The first 2,000 lines of a log."""
    return readers.load_sample(spark, _written_log(spark, sf_dir), v.ORDER_FORMAT)


_QUOTED = "concat(Content, ' say \"', event_type, '\", a\\\\b')"
_QUOTED_SQL = "concat(Content, ' say \"', event_type, '\", a\\b')"


@register(f"""select LineId as "LineId", {_QUOTED_SQL} as "Content", case when event_type <> 'view' then 'E ' || event_type end as "EventId", event_type || ', <*>' as "EventTemplate" from {v.EVENTS_SQL}""")
def structured_csv(spark, sf_dir):
    """Structured lines with quotes, commas, backslashes and null ids written as CSV and read as ground truth."""
    lines = v.events(spark, sf_dir).select(
        "LineId", F.expr(_QUOTED).alias("Content"), F.expr("case when event_type <> 'view' then 'E ' || event_type end").alias("EventId"), F.concat("event_type", F.lit(", <*>")).alias("EventTemplate")
    )
    sinks.write_structured(lines, path := _folder(spark, "structured"))
    return readers.load_groundtruth(spark, path)


@register(ORACLE["template_counts"])
def templates_csv(spark, sf_dir):
    """Template counts written as one CSV file and read back."""
    sinks.write_templates(QUERIES["template_counts"](spark, sf_dir), path := _folder(spark, "templates"))
    return readers.load_templates(spark, path)


@register(_TRUTH_SQL + """ select LineId as "LineId", Content as "Content", event as "EventId", template as "EventTemplate" from lines join ids using (template)""")
def ground_truth_files(spark, sf_dir):
    """Truth built from an annotation file, written and read back; later annotations of a content override earlier ones."""
    lines = _templated(spark, sf_dir)
    notes = lines.where("event_type <> 'error'").select("Content", "EventTemplate", "LineId")
    rows = notes.withColumn("n", F.lit(1)).union(notes.select("Content", F.lit("wrong"), "LineId", F.lit(0))).orderBy("n", "LineId")
    sinks.write_csv(rows.select("Content", "EventTemplate"), path := _folder(spark, "notes"))
    structured, _ = build_groundtruth(lines.select("LineId", "Content"), readers.load_annotations(spark, path))
    sinks.write_structured(structured, truth := _folder(spark, "truth"))
    return readers.load_groundtruth(spark, truth)


@register(f"""select text as content, template, replace(text, '#', '#0') as "Postive_Example", case when p_type <> 'ECONOMY' then p_name || ' "' || p_type || '"' end as "Negative_Example" from {v.PARTS_SQL}""")
def examples_json(spark, sf_dir):
    """Examples written as JSON and read back."""
    parts = v.parts(spark, sf_dir).select(
        F.col("text").alias("content"), "template", F.replace("text", F.lit("#"), F.lit("#0")).alias("Postive_Example"),
        F.expr("case when p_type <> 'ECONOMY' then p_name || ' \"' || p_type || '\"' end").alias("Negative_Example"),
    )
    sinks.write_examples(parts, path := _folder(spark, "examples"))
    return readers.load_example_lines(spark, path).drop("id")


@register(_EVAL_SQL + """ select 'GA' as metric, round(ga, 6) as events from g union all select 'FGA', round(2 * pga * rga / (pga + rga), 6) from g
    union all select 'PA', round(pa, 6) from k union all select 'FTA', round(2 * pta * rta / (pta + rta), 6) from k""")
def benchmark_csv(spark, sf_dir):
    """The benchmark table written as CSV and read back."""
    scores = ev.evaluate(*_truth_and_parse(spark, sf_dir)).select(F.lit("events").alias("Dataset"), *(F.round(c, 6).alias(c) for c in ("GA", "FGA", "PA", "FTA")))
    sinks.write_benchmark(scores, path := _folder(spark, "benchmark"))
    return readers.read_csv(spark, path, "metric string, events double")
