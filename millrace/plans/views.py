"""Message views over the star-schema tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LineId, Content, event_type, ts, value of the event stream."""
    content = "concat_ws(' ', event_type, 'user', user_id, 'value', cast(floor(value * 100) as bigint), props)"
    return table(spark, sf_dir, "events").selectExpr("event_id + 1 as LineId", f"{content} as Content", "event_type", "ts", "value")


EVENTS_SQL = """(select event_id + 1 as LineId,
    concat_ws(' ', event_type, 'user', cast(user_id as varchar), 'value', cast(cast(floor(value * 100) as bigint) as varchar), props) as Content,
    event_type, ts, value from events)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id as LineId", "url as Content")


URLS_SQL = "(select page_id as LineId, url as Content from pages)"


def orders_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LineId and value; every seventh line does not follow ORDER_FORMAT."""
    text = "concat('[', date_format(o_orderdate, 'yyyy-MM-dd'), '] ', o_orderstatus, if(o_orderkey % 7 = 0, ' ~ order ', ' - order '), o_orderkey, ' priority ', o_orderpriority)"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} as value")


ORDER_FORMAT = r"\[<Date>\] <Status> - order <Order> priority <Content>"
ORDERS_SQL = """(select o_orderkey, concat('[', strftime(o_orderdate, '%Y-%m-%d'), '] ', o_orderstatus,
    case when o_orderkey % 7 = 0 then ' ~ order ' else ' - order ' end, cast(o_orderkey as varchar), ' priority ', o_orderpriority) as value from orders)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LineId and Content of the largest table."""
    text = "concat('order ', l_orderkey, ' line ', l_linenumber, ' part ', l_partkey, ' supp ', l_suppkey, ' flag ', l_returnflag)"
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as LineId", f"{text} as Content")


ITEMS_SQL = """(select l_orderkey * 10 + l_linenumber as LineId, concat('order ', cast(l_orderkey as varchar), ' line ', cast(l_linenumber as varchar),
    ' part ', cast(l_partkey as varchar), ' supp ', cast(l_suppkey as varchar), ' flag ', l_returnflag) as Content from lineitem)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text and template (the brand is the variable) of parts."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "concat(p_name, ' / ', p_type, ' / ', p_brand) as text", "concat(p_name, ' / ', p_type, ' / <*>') as template", "p_name", "p_type", "p_brand"
    )


PARTS_SQL = """(select p_partkey as id, concat(p_name, ' / ', p_type, ' / ', p_brand) as text,
    concat(p_name, ' / ', p_type, ' / <*>') as template, p_name, p_type, p_brand from part)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos and value, the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"))


DOCUMENT_LINES_SQL = """(select doc_id, i - 1 as pos, value from (select doc_id, unnest(string_split(text, chr(10))) as value,
    generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""
