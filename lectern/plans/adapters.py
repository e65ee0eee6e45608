"""Library views on the driver tables. The same text runs on Spark ({table} is a DataFrame) and on DuckDB (a view)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

KEY = "concat('D', lpad(cast({} as varchar(20)), 7, '0'))"

SQL = {
    "items": f"""
select {KEY.format("doc_id")} as key,
  case cast(doc_id % 5 as int) when 0 then 'journalArticle' when 1 then 'book' when 2 then 'thesis' when 3 then 'webpage' else 'blogPost' end as type,
  replace(substr(text, 1, 80), chr(10), ' ') as title,
  case when doc_id % 7 = 0 then '' else concat(cast(1990 + doc_id % 35 as varchar(20)), '-0', cast(1 + doc_id % 9 as varchar(20))) end as date,
  case when doc_id % 3 = 0 then '' else substr(text, 81, 400) end as abstract,
  case when doc_id % 4 = 0 then '' else concat('10.5555/', md5(text)) end as doi,
  case when doc_id % 11 = 0 then '' else split_part(text, ' ', 1) end as last_name,
  split_part(text, ' ', 2) as first_name,
  lang as language, source as publisher, doc_id as scan_order
from {{documents}}""",
    "collections": """
select concat('REG', lpad(cast(r_regionkey as varchar(20)), 5, '0')) as key, cast(null as varchar(20)) as parent_key, r_name as name from {region}
union all
select concat('NAT', lpad(cast(n_nationkey as varchar(20)), 5, '0')), concat('REG', lpad(cast(n_regionkey as varchar(20)), 5, '0')), n_name from {nation}
union all
select distinct concat('SEG', lpad(cast(c_nationkey as varchar(20)), 2, '0'), substr(c_mktsegment, 1, 3)), concat('NAT', lpad(cast(c_nationkey as varchar(20)), 5, '0')), c_mktsegment from {customer}""",
    "item_collections": f"""
select {KEY.format("doc_id")} as item_key, concat('NAT', lpad(cast(doc_id % 25 as varchar(20)), 5, '0')) as collection_key from {{documents}}
union all
select {KEY.format("doc_id")}, concat('REG', lpad(cast(doc_id % 5 as varchar(20)), 5, '0')) from {{documents}} where doc_id % 6 = 0""",
    "item_tags": f"""
select {KEY.format("doc_id")} as item_key, case when doc_id % 5 = 0 then upper(lang) else lang end as tag from {{documents}}
union all
select {KEY.format("doc_id")}, case when doc_id % 2 = 0 then source else concat(' ', upper(source), '  ') end from {{documents}}
union all
select {KEY.format("doc_id")}, 'toxic' from {{labels}} where toxic = 1""",
    "attachments": """
select concat('L', md5(concat(cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))))) as key,
  case when l_linenumber % 4 = 0 then null else concat('O', lpad(cast(l_orderkey as varchar(20)), 8, '0')) end as parent_key,
  case l_returnflag when 'A' then 'application/pdf' when 'N' then 'text/html' else 'image/png' end as content_type,
  cast(floor(l_extendedprice * 1000) as bigint) as size,
  cast(l_suppkey % 4 as int) as annotations, cast(l_partkey % 3 as int) as n_collections, cast(l_partkey % 2 as int) as n_tags,
  (l_linenumber % 5 = 0) as deleted, (l_linestatus = 'O' and l_linenumber = 1) as linked, (l_partkey % 10 <> 9) as has_file,
  (l_partkey % 13 = 0) as done
from {lineitem}""",
    "parents": """
select concat('O', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as key, concat(o_orderpriority, ' order of customer ', cast(o_custkey as varchar(20)), ' with a title that is long enough to be cut off somewhere') as title,
  cast(o_orderdate as varchar(20)) as date from {orders}""",
    "audit": "select event_id, ts, user_id, event_type as label, (event_type <> 'error') as ok, value as code_bytes, props from {events}",
    "notes": f"""
select conv_id, turn, role as annotation_type, text, {KEY.format("conv_id")} as item_key from {{conversations}}""",
    "candidates": f"""
select {KEY.format("doc_id")} as item_key, cast(1 as int) as rank, concat('10.5555/', md5(text)) as doi,
  replace(substr(text, 1, case when doc_id % 3 = 0 then 70 else 80 end), chr(10), ' ') as title,
  cast(1990 + doc_id % 35 + doc_id % 4 as int) as year, case when doc_id % 5 = 0 then 'Nobody' else split_part(text, ' ', 1) end as author, substr(text, 81, 400) as abstract
from {{documents}}
union all
select {KEY.format("doc_id")}, 2, concat('10.5555/b', cast(item_id as varchar(20))), replace(substr(b.text, 1, 80), chr(10), ' '), 2000, 'Bench', substr(b.text, 81, 400)
from {{documents}} d join {{benchmark}} b on item_id = doc_id % 40""",
    # text lines with a made-up geometry, eight lines a page
    "pdf_lines": """
select doc_id, ord, cast(1 + floor(ord / 8) as int) as page, text,
  cast(case when length(text) < 40 then 16 when length(text) < 80 then 12 else 10 end as double) as size, (length(text) % 3 = 0) as bold,
  cast(72 + 18 * (ord % 3) as double) as x0, cast(72 + 18 * (ord % 3) + least(length(text), 60) * 5 as double) as x1,
  cast(40 + 70 * (ord % 8) as double) as y, cast(52 + 70 * (ord % 8) as double) as y1, cast(420 as double) as page_width, cast(640 as double) as page_height, cast(1 + ord % 3 as int) as lines_in_block
from {lines}""",
    # the same lines, of which every third document's first ones read like a contents page
    "toc_lines": """
select doc_id, ord, cast(1 + floor(ord / 8) as int) as page, case when doc_id % 3 = 0 and ord = 0 then 'Contents' when doc_id % 3 = 0 and ord < 12 then concat(substr(text, 1, 30), ' ..... ', cast(ord + 5 as varchar(20))) else text end as text,
  cast(72 as double) as x0, cast(300 as double) as x1, cast(40 + 14 * (ord % 8) as double) as y, cast(52 + 14 * (ord % 8) as double) as y1
from {lines}""",
    # the same, and other documents' first lines have their numbers in a column of their own, on a few lines none
    "column_lines": """
select doc_id, cast(2 * ord as bigint) as ord, cast(1 + floor(ord / 8) as int) as page, case when doc_id % 3 < 2 and ord = 0 then 'Contents' when doc_id % 3 = 0 and ord < 12 then concat(substr(text, 1, 30), ' ..... ', cast(ord + 5 as varchar(20)))
    when doc_id % 3 = 1 and ord < 12 then substr(text, 1, 30) else text end as text,
  cast(72 + 9 * (ord % 3) as double) as x0, cast(300 + ord % 5 as double) as x1, cast(40 + 14 * (ord % 8) as double) as y, cast(52 + 14 * (ord % 8) as double) as y1
from {lines}
union all select doc_id, cast(2 * ord + 1 as bigint), cast(1 + floor(ord / 8) as int), cast(ord + 5 as varchar(20)), 350, 360, cast(40 + 14 * (ord % 8) + 7 * (ord % 2) as double), cast(52 + 14 * (ord % 8) + 7 * (ord % 2) as double)
from {lines} where doc_id % 3 = 1 and ord < 12 and ord % 4 <> 2""",
    "links": """
select doc_id, ord as link_ord, cast(1 + floor(ord / 8) as int) as page, cast(3 + floor(ord / 2) as int) as target, cast(70 as double) as x0, cast(310 as double) as x1, cast(39 + 14 * (ord % 8) as double) as y, cast(53 + 14 * (ord % 8) as double) as y1
from {lines}""",
    "edits": f"""
select doc_id as seq, {KEY.format("doc_id % 300")} as key,
  case when doc_id % 3 = 0 then 'title' when doc_id % 3 = 1 then 'date' else 'doi' end as field, concat('v', cast(doc_id as varchar(20))) as value,
  case when doc_id % 4 = 0 then lang when doc_id % 4 = 1 then concat('new', cast(doc_id % 7 as varchar(20))) else null end as tag, (doc_id % 8 = 0) as remove_tag, (doc_id % 50 = 49) as trash
from {{documents}}""",
    # ink per column of sampled pages: a profile of 60 columns a document
    "ink": """
select e.user_id as doc_id, cast(e.event_id % 60 as int) as i, cast(min(floor(e.value)) as double) / 100 as ink from {events} e group by e.user_id, cast(e.event_id % 60 as int)""",
    "gutters": """
select user_id as doc_id, event_id as page, cast(case when event_id % 9 = 0 then null else 0.45 + (event_id % 11) / 100.0 end as double) as cut, cast((event_id % 13) / 100.0 as double) as ink from {events}""",
}
#: Lines of documents, spelled for each engine.
SPARK_LINES = "select doc_id, pos as ord, line as text from (select doc_id, posexplode(split(text, '\\n')) as (pos, line) from {documents}) where line <> ''"
DUCK_LINES = "select doc_id, ord, text from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as text from documents) where text <> ''"
BASE = ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "benchmark", "labels", "conversations", "pages", "part", "supplier"]


class Views:
    """The views as DataFrames; each is a lazy plan over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        used = {n: self.table(n) for n in BASE if "{" + n + "}" in text and n not in frames}
        return self.spark.sql(text, **used, **frames)

    @cached_property
    def lines(self) -> DataFrame:
        return self.sql(SPARK_LINES)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            return self.sql(SQL[name], **({"lines": self.lines} if "{lines}" in SQL[name] else {}))
        raise AttributeError(name)


def duck(views: str, body: str) -> str:
    """DuckDB text: the named views as common table expressions, then the body."""
    names = views.split()
    parts = [f"lines as ({DUCK_LINES})"] if any("{lines}" in SQL[n] for n in names) else []
    parts += [f"{n} as ({SQL[n].format(lines='lines', **{b: b for b in BASE})})" for n in names]
    recursive = "recursive " if "recursive:" in body else ""
    return f"with {recursive}{', '.join(parts)}{body.replace('recursive:', '')}" if body.lstrip().startswith((",", "recursive:")) else f"with {', '.join(parts)} {body}"
