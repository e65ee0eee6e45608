"""The registered queries on library views, and the same rows as DuckDB text.

A query without text here cannot be said in SQL (the gestalt ratio, folds over ordered rows) and is tested against a plain
Python version in tests/test_plain.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze, catalog, dedupe, edits, enrich, outline, scan_prep, storage, tags
from ..session import shared_path, written
from ..sources import library
from ..sources import pages as list_pages
from ..streaming import audit, markers
from .adapters import Views, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str = "") -> Callable:
    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck(views, sql) if views else sql
        return f

    return add


# Pieces of DuckDB text
NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
YEAR = "nullif(regexp_extract({0}, '\\d{{4}}', 0), '')"
BLANK = "regexp_full_match(coalesce({0}, ''), '\\s*')"
NAME = "trim(concat(first_name, ' ', last_name))"
SIM = "case when {0} = {1} then 1.0 when {0} = '' or {1} = '' then 0.0 else 1.0 - levenshtein({0}, {1})::double / greatest(length({0}), length({1})) end"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
MB25 = 25 * 1024 * 1024


# ---- statistics and search
@query("items collections item_tags attachments", """select (select count(*) from items) as total_items, (select count(*) from items where trim(coalesce(abstract, '')) = '') as without_abstract,
  (select count(*) from items where key in (select parent_key from attachments where content_type = 'application/pdf' and not deleted)) as with_pdf,
  (select count(*) from collections) as collections, (select count(distinct tag) from item_tags) as tags,
  (select count(*) from items where key not in (select parent_key from attachments where parent_key is not null and content_type = 'application/pdf' and not deleted)) as without_pdf""")
def stats_totals(v: Views) -> DataFrame:
    return analyze.stats_totals(v.items, v.collections, v.item_tags, v.attachments)


@query("items", "select type, count(*) as n from items group by type")
def stats_by_type(v: Views) -> DataFrame:
    return analyze.stats_by_type(v.items)


@query("items", f"select coalesce({YEAR.format('date')}, '(none)') as year, count(*) as n from items group by 1")
def stats_by_year(v: Views) -> DataFrame:
    return analyze.stats_by_year(v.items)


def _missing(field: str) -> None:
    @query("items", f"select key, type, title from items where {BLANK.format(field)}")
    def missing(v: Views) -> DataFrame:
        return analyze.missing(v.items, field).select("key", "type", "title")

    QUERIES[f"missing_{field}"], ORACLES[f"missing_{field}"] = QUERIES.pop("missing"), ORACLES.pop("missing")


for _f in ("abstract", "doi", "date"):
    _missing(_f)


@query("items", "select x.field, (select count(*) from items) as total, x.missing from (" + " union all ".join(f"select '{f}' as field, count(*) filter ({BLANK.format(f)}) as missing from items" for f in ("title", "abstract", "doi", "date")) + ") x")
def missing_counts(v: Views) -> DataFrame:
    return analyze.missing_counts(v.items, ["title", "abstract", "doi", "date"])


@query("items item_collections", f"select key, title from items where key in (select item_key from item_collections where collection_key = 'NAT00007') and {BLANK.format('abstract')}")
def missing_in_collection(v: Views) -> DataFrame:
    return analyze.missing(catalog.scope(v.items, v.item_collections, "NAT00007"), "abstract").select("key", "title")


@query("items", f"select key, {NAME} as author, date from items where contains(lower({NAME}), 'the')")
def author_search(v: Views) -> DataFrame:
    return analyze.by_author(v.items, "The").select("key", T.display_name(F.col("first_name"), F.col("last_name")).alias("author"), "date")


@query("items", "select key, title from items order by scan_order desc, key limit 20")
def recent_items(v: Views) -> DataFrame:
    return analyze.recent(v.items).select("key", "title")


@query("items item_tags", f"select key, type, title from items where type = 'book' and contains(lower(concat_ws(' ', title, first_name, last_name, coalesce({YEAR.format('date')}, ''))), 'the') and contains(lower(concat_ws(' ', title, first_name, last_name, coalesce({YEAR.format('date')}, ''))), '20') and key in (select item_key from item_tags where tag = 'en')")
def search_filtered(v: Views) -> DataFrame:
    return analyze.search(v.items, "the 20", "book", "en", v.item_tags).select("key", "type", "title")


def _wire(v: Views) -> DataFrame:
    """Wire records from items, with the venue in one of four places."""
    place = F.substring("key", 8, 1)
    data = F.struct(
        F.col("type").alias("itemType"), "title", "date", F.col("doi").alias("DOI"), F.lit("").alias("url"), F.when(place == "0", F.lit("")).otherwise(F.concat(F.lit("c"), F.col("key"))).alias("citationKey"), F.col("abstract").alias("abstractNote"),
        F.when(place < "3", F.col("publisher")).otherwise("").alias("publicationTitle"), F.when(place < "5", F.lit("Book")).otherwise("").alias("bookTitle"), F.when(place < "7", F.col("publisher")).otherwise("").alias("publisher"), F.when(place < "9", F.lit("Uni")).alias("university"),
        F.array(F.struct(F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"), F.lit("Solo").alias("name"), F.lit("author").alias("creatorType"))).alias("creators"),
        F.array(F.struct(F.col("language").alias("tag")), F.struct(F.col("publisher").alias("tag"))).alias("tags"),
    )
    return v.items.select("key", data.alias("data"))


_VENUE = "case when substr(key, 8, 1) < '3' then publisher when substr(key, 8, 1) < '5' then 'Book' when substr(key, 8, 1) < '7' then publisher when substr(key, 8, 1) < '9' then 'Uni' else '' end"
_FLAT = f"key, case when substr(key, 8, 1) = '0' then null else concat('c', key) end as citekey, type, title, date, {YEAR.format('date')} as year, trim(concat(first_name, ' ', case when last_name = '' then 'Solo' else last_name end)) as creators, {_VENUE} as venue, doi, '' as url, concat(language, '; ', publisher) as tags"


@query("items", f"select {_FLAT}, abstract from items")
def flatten_items(v: Views) -> DataFrame:
    return analyze.flatten_wire(_wire(v)).withColumns({"creators": F.array_join("creators", "; "), "tags": F.array_join("tags", "; ")})


@query("items", f"select {_FLAT} from items")
def export_csv_rows(v: Views) -> DataFrame:
    return analyze.export_rows(analyze.project(analyze.flatten_wire(_wire(v)), "full"))


@query("items", "select key, type, title, date, doi, last_name, first_name, language, publisher, scan_order from items")
def concise_items(v: Views) -> DataFrame:
    return analyze.project(v.items)


# ---- scopes
@query("items item_collections", "select key, title from items where key in (select item_key from item_collections where collection_key = 'NAT00003')")
def collection_items_direct(v: Views) -> DataFrame:
    return catalog.in_collection(v.items, v.item_collections, "NAT00003").select("key", "title")


@query("items collections item_collections", """select key, title from items where key in (select item_key from item_collections where collection_key in
  (select 'REG00001' union select c.key from collections c where c.parent_key = 'REG00001' union select s.key from collections s join collections n on s.parent_key = n.key where n.parent_key = 'REG00001'))""")
def collection_items_recursive(v: Views) -> DataFrame:
    return catalog.in_collection_tree(v.items, v.item_collections, v.collections, "REG00001").select("key", "title")


_PATHS = """paths as (select a.key, case when b.key is null then a.name when c.key is null then concat(b.name, ' / ', a.name) else concat(c.name, ' / ', b.name, ' / ', a.name) end as path,
  case when b.key is null then 0 when c.key is null then 1 else 2 end as depth from collections a left join collections b on a.parent_key = b.key left join collections c on b.parent_key = c.key)"""


@query("collections", f", {_PATHS} select key, path, depth from paths")
def collection_paths(v: Views) -> DataFrame:
    return catalog.collection_paths(v.collections)


@query("collections item_collections", "select c.key, c.name, c.parent_key, count(distinct m.item_key) as n_items from collections c left join item_collections m on m.collection_key = c.key group by all")
def collection_counts(v: Views) -> DataFrame:
    return catalog.collections_with_counts(v.collections, v.item_collections)


@query("item_tags", "select tag, count(distinct item_key) as n_items from item_tags group by tag")
def tag_counts(v: Views) -> DataFrame:
    return catalog.tags_with_counts(v.item_tags)


@query("collections", "select key from collections where name = 'ASIA' order by key limit 1")
def collection_by_name(v: Views) -> DataFrame:
    return v.collections.where(F.col("key") == catalog.resolve_collection(v.collections, "ASIA")).select("key")


@query("items", "select key, title from items where key in ('D0000001', 'D0000005', 'D0000007')")
def items_by_key(v: Views) -> DataFrame:
    cite = v.items.select(F.concat(F.lit("c"), "key").alias("citekey"), "key")
    return catalog.by_keys(v.items, ["D0000001", "@cD0000005", "D0000001", "cD0000007"], cite).select("key", "title")


@query("parents attachments", "select p.key, p.title, 'order' as type, coalesce(string_agg(a.key, ',' order by a.key), '') as pdfs from parents p left join (select distinct key, parent_key from attachments where content_type = 'application/pdf' and not deleted) a on a.parent_key = p.key group by all")
def cite_pdfs(v: Views) -> DataFrame:
    return catalog.cite(v.parents.withColumn("type", F.lit("order")), v.attachments).withColumn("pdfs", F.array_join("pdfs", ","))


# ---- lint
@query("items", f"select key from items where {BLANK.format('date')}")
def lint_no_date(v: Views) -> DataFrame:
    return analyze.lint_no_date(v.items).select("key")


@query("items", f"select key from items where {BLANK.format('first_name')} and {BLANK.format('last_name')}")
def lint_no_creators(v: Views) -> DataFrame:
    return analyze.lint_no_creators(v.items).select("key")


@query("items", "select key as item_key, last_name as name from items where regexp_matches(last_name, '(?i),| y | & |;| and ')")
def lint_combined_creators(v: Views) -> DataFrame:
    own = v.items.select(F.col("key").alias("item_key"), F.lit(0).alias("ord"), F.col("last_name").alias("name"))
    return analyze.lint_combined_creators(own.union(own.select("item_key", F.lit(1).alias("ord"), F.lit("a and b").alias("name")).where("name = ''")))


@query("items", f"select key, title, first from (select key, title, first_value(key) over w as first, row_number() over w as n from (select *, regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g') as t from items) where t <> '' window w as (partition by t order by scan_order)) where n > 1")
def lint_duplicate_titles(v: Views) -> DataFrame:
    return analyze.lint_duplicate_titles(v.items)


def _single_field(v: Views) -> DataFrame:
    return v.items.select(F.col("key").alias("item_key"), F.lit(0).alias("ord"), F.concat_ws(" and ", "last_name", F.when(F.col("scan_order") % 6 == 0, F.col("first_name"))).alias("name"))


@query("items", f"""select 'no_date' as rule, count(*) filter ({BLANK.format('date')}) as n from items union all select 'no_creators', count(*) filter ({BLANK.format('first_name')} and {BLANK.format('last_name')}) from items
  union all select 'combined_creators', count(*) filter (regexp_matches(concat_ws(' and ', last_name, case when scan_order % 6 = 0 then first_name end), '(?i),| y | & |;| and ')) from items
  union all select 'duplicate_titles', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from items where not {BLANK.format('title')} group by regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g'))""")
def lint_report(v: Views) -> DataFrame:
    return analyze.lint_report(v.items, _single_field(v))


@query("items", "select key from items")
def item_keys(v: Views) -> DataFrame:
    return catalog.keys_of(v.items)


@query("items", "select key, title, (select count(*) from items) as total from items order by title, key limit 25")
def items_page(v: Views) -> DataFrame:
    rows, total = catalog.page_of(v.items, [F.col("title"), F.col("key")])
    return rows.select("key", "title", F.lit(total).cast("long").alias("total"))


@query("items attachments", "select 'new' || key as key, key as parent_key, case when scan_order % 3 = 0 then 'file' when scan_order % 3 = 1 then 'link' else 'snapshot' end as mode from items where type = 'book' union all select key, parent_key, null from attachments")
def attach_rows(v: Views) -> DataFrame:
    kind = F.col("scan_order") % 3
    new = v.items.where("type = 'book'").select(F.concat(F.lit("new"), "key").alias("key"), F.col("key").alias("parent_key"), F.when(kind == 0, "/f.pdf").alias("file"), F.when(kind > 0, "http://x").alias("url"), (kind == 1).alias("link"))
    return edits.attach(v.attachments, v.items, new).select("key", "parent_key", "mode")


@query("items", "select key, case when contains(title, '<') then title else concat('<p>', regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '</p>') end as html from items where not regexp_full_match(title, '\\s*')")
def text_html(v: Views) -> DataFrame:
    return v.items.where(~T.is_blank("title")).select("key", T.text_to_html("title").alias("html"))


@query("attachments", "select key, case when size < 1024 then printf('%.0f B', size::double) when size < 1048576 then printf('%.1f KB', size / 1024.0) when size < 1073741824 then printf('%.1f MB', size / 1048576.0) when size < 1099511627776 then printf('%.1f GB', size / 1073741824.0) else printf('%.1f TB', size / 1099511627776.0) end as binary_size, printf('%.1f MB', size / 1e6) as decimal_size from attachments")
def human_sizes(v: Views) -> DataFrame:
    return v.attachments.select("key", T.human_size_binary("size").alias("binary_size"), T.human_size_decimal("size").alias("decimal_size"))


@query("items", "select scan_order, [cast(scan_order % 7 as int), cast(scan_order % 11 as int), 0]::varchar as parts from items")
def version_parts(v: Views) -> DataFrame:
    version = F.concat_ws(".", (F.col("scan_order") % 7).cast("string"), F.concat((F.col("scan_order") % 11).cast("string"), F.lit("b2")), F.lit("x"))
    return v.items.select("scan_order", F.concat(F.lit("["), F.array_join(T.version_tuple(version).cast("array<string>"), ", "), F.lit("]")).alias("parts"))


@query("attachments parents", "select p.key from (select key from parents union all select concat('N', key) from parents) p where p.key not in (select key from attachments) and p.key not in (select parent_key from attachments where parent_key is not null)")
def unmatched_keys(v: Views) -> DataFrame:
    asked = v.parents.select("key").union(v.parents.select(F.concat(F.lit("N"), "key")))
    return storage.unmatched_keys(v.attachments, asked)


@query("items notes", f"select n.item_key, conv_id, turn, substr({SQUEEZE.format(chr(34) + 'x' + chr(34))}, 1, 100) as preview from (select *, regexp_replace(text, '<[^>]+>', ' ', 'g') as x from notes) n where item_key in (select key from items)")
def notes_preview(v: Views) -> DataFrame:
    return analyze.notes_preview(v.notes, v.items)


@query("notes", "select item_key, string_agg(concat('<p>[p. ', coalesce(cast(turn as varchar), '?'), '] ', coalesce(text, ''), '</p>'), '' order by conv_id, turn) as html from notes group by item_key")
def annotations_html(v: Views) -> DataFrame:
    return analyze.annotations_html(v.notes)


@query("items", "select a.key as item_key, b.key as related_key, b.title from items a join items b on b.key = concat('D', lpad(cast(a.scan_order * 2 as varchar), 7, '0'))")
def related_items(v: Views) -> DataFrame:
    rel = v.items.select(F.col("key").alias("item_key"), F.concat(F.lit("D"), F.lpad((F.col("scan_order") * 2).cast("string"), 7, "0")).alias("related_key"))
    return analyze.related(v.items, rel)


@query("items", f"select key, {NORM.format('title')} as norm, {KEY.format('title')} as dedupe_key, cast({YEAR.format('date')} as int) as year from items")
def norm_title(v: Views) -> DataFrame:
    return v.items.select("key", T.norm_title("title").alias("norm"), T.dedupe_key("title").alias("dedupe_key"), T.year_of("date").alias("year"))


@query("pages", "")
def clean_abstract(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.clean_abstract("html").alias("abstract"))


@query(sql="select page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100) as preview from pages")
def html_preview(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.note_preview("html").alias("preview"))


@query("audit", "select event_id, substr(sha256(concat(label, props)), 1, 16) as code_hash from audit")
def code_hashes(v: Views) -> DataFrame:
    return v.audit.select("event_id", T.code_hash(F.concat("label", "props")).alias("code_hash"))


# ---- storage
@query("attachments parents", f"select a.key, a.parent_key, coalesce(substr(p.title, 1, 70), '') as title, coalesce({YEAR.format('p.date')}, '') as year, content_type, size from attachments a left join parents p on a.parent_key = p.key")
def attachment_inventory(v: Views) -> DataFrame:
    return storage.inventory(v.attachments, v.parents)


@query("attachments", "".join(f"{' union all ' if k else ''}select '{n}' as kind, count(*) as n, coalesce(sum(size), 0)::bigint as bytes from attachments where {c}" for k, (n, c) in enumerate({"pdfs": "content_type = 'application/pdf'", "snapshots": "content_type = 'text/html'", "orphans": "parent_key is null", "trashed": "deleted", "total": "true"}.items())))
def disk_summary(v: Views) -> DataFrame:
    return storage.disk_summary(v.attachments)


@query("attachments", f"select key, size from attachments where content_type = 'application/pdf' and not deleted and size >= {MB25} order by size desc, key limit 15")
def heavy_pdfs(v: Views) -> DataFrame:
    return storage.heavy_pdfs(v.attachments).select("key", "size")


_ORPHAN = "parent_key is null and n_collections = 0 and n_tags = 0 and annotations = 0 and not deleted"


@query("attachments", f"select key, size, case when {_ORPHAN} then 'orphan' else 'snapshot' end as reason from attachments where ({_ORPHAN}) or (parent_key is not null and content_type = 'text/html' and annotations = 0 and not deleted)")
def gc_plan(v: Views) -> DataFrame:
    return storage.gc_plan(v.attachments)


@query("attachments", f"select reason, count(*) as n, sum(size)::bigint as bytes from (select size, case when deleted then 'trash' when {_ORPHAN} then 'orphan' when parent_key is not null and content_type = 'text/html' then (case when annotations = 0 then 'snapshot' else 'kept-annotated' end) end as reason from attachments) where reason is not null group by reason")
def gc_summary(v: Views) -> DataFrame:
    return storage.gc_summary(v.attachments)


@query("attachments", f"select key, deleted or (({_ORPHAN}) or (parent_key is not null and content_type = 'text/html' and annotations = 0 and not deleted)) as deleted from attachments")
def gc_execute(v: Views) -> DataFrame:
    return storage.gc_execute(v.attachments, storage.gc_plan(v.attachments).dropDuplicates(["key"])).select("key", "deleted")


@query("attachments", f"select key, size from attachments where content_type = 'application/pdf' and has_file and not deleted and not linked and size >= {MB25} and size < {4 * MB25} and not done")
def shrink_targets(v: Views) -> DataFrame:
    return storage.shrink_targets(v.attachments, below=4 * MB25).select("key", "size")


@query("attachments", "select distinct key from attachments where content_type = 'application/pdf' and has_file and not deleted and not linked and (parent_key in (select concat('O', lpad(cast(o_orderkey as varchar), 8, '0')) from orders where o_orderpriority = '1-URGENT'))")
def shrink_targets_by_key(v: Views) -> DataFrame:
    keys = v.table("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("key"))
    return storage.shrink_targets(v.attachments, keys=keys).select("key")


_RESULTS = "select l_orderkey as id, l_linenumber as part, case when l_linenumber = 7 then null else cast(floor(l_extendedprice) as bigint) end as size_before, cast(floor(l_extendedprice * (l_quantity % 12) / 10) as bigint) as size_after, cast(l_quantity as int) as pages_before, case when l_linenumber = 6 then null when l_tax > 0.06 then cast(l_quantity as int) + 1 else cast(l_quantity as int) end as pages_after from {lineitem}"


def _results(v: Views) -> DataFrame:
    return v.sql(_RESULTS)


_REASON = "case when coalesce(size_after, 0) <= 0 then 'empty output' when pages_before is null or pages_after is null then 'unreadable page count' when pages_before <> pages_after then 'page count differs' when coalesce(round(size_after / nullif(size_before, 0), 6), 1.0) > 0.8 then 'no meaningful gain' else 'ok' end"


@query(sql=f"select id, part, size_after, {_REASON} as reason from ({_RESULTS.format(lineitem='lineitem')})")
def shrink_verdict(v: Views) -> DataFrame:
    return _results(v).select("id", "part", "size_after", storage.shrink_verdict(F.col("size_before"), F.col("size_after"), F.col("pages_before"), F.col("pages_after"))["reason"].alias("reason"))


@query(sql=f"select status, count(*) as n, sum(case when status = 'shrunk' then size_before - size_after else 0 end)::bigint as bytes_saved from (select *, case when size_before is null then 'missing-file' when reason = 'ok' then 'shrunk' when reason = 'no meaningful gain' then 'kept' else 'failed' end as status from (select *, {_REASON} as reason from ({_RESULTS.format(lineitem='lineitem')}))) group by status")
def status_histogram(v: Views) -> DataFrame:
    return storage.shrink_report(_results(v))


# ---- duplicates
def _groups(by: str) -> str:
    k = KEY.format("title") if by == "title" else "lower(trim(doi))"
    return f"g as (select *, {k} as k from items where {k} <> '')"


@query("items", f", {_groups('title')} select k, count(*) as n, min_by(key, scan_order) as first from g group by k having count(*) > 1")
def dedupe_title(v: Views) -> DataFrame:
    return dedupe.exact_groups(v.items)


@query("items", f", {_groups('doi')} select k, count(*) as n, min_by(key, scan_order) as first from g group by k having count(*) > 1")
def dedupe_doi(v: Views) -> DataFrame:
    return dedupe.exact_groups(v.items, "doi")


@query("items", f", {_groups('title')} select k, key, f as first from (select k, key, first_value(key) over (partition by k order by scan_order) as f, count(*) over (partition by k) as n from g) where n > 1")
def dedupe_members(v: Views) -> DataFrame:
    return dedupe.exact_members(v.items)


_SINGLES = f"{_groups('title')}, s as (select k, min(key) as key, min(scan_order) as scan_order, substr(k, 1, 6) as block from g group by k having count(*) = 1)"


@query("items", f", {_SINGLES} select a.key as key_a, b.key as key_b, round({SIM.format('a.k', 'b.k')}, 6) as similarity from s a join s b on a.block = b.block and a.scan_order < b.scan_order where {SIM.format('a.k', 'b.k')} >= 0.9")
def dedupe_fuzzy_pairs(v: Views) -> DataFrame:
    return dedupe.fuzzy_pairs(v.items)


@query()
def dedupe_fuzzy_clusters(v: Views) -> DataFrame:
    return dedupe.fuzzy_clusters(v.items)


_FORMAL = ", ".join(f"'{t}'" for t in dedupe.FORMAL)
_EDITION = "case cast(scan_order % 9 as int) when 0 then '2nd ed.' when 4 then '3rd' else '' end"
_VERDICT = f"""g as (select *, {KEY.format('title')} as k, {_EDITION} as edition from items where {KEY.format('title')} <> ''), m as (select k, count(*) as n, list_distinct(list({NORM.format('last_name')}) filter ({NORM.format('last_name')} <> '')) as authors,
    list_distinct(list({NORM.format('edition')}) filter ({NORM.format('edition')} <> '')) as editions, min(cast({YEAR.format('date')} as int)) as low, max(cast({YEAR.format('date')} as int)) as high, list_sort(list_distinct(list(type) filter (type in ({_FORMAL})))) as types from g group by k having count(*) > 1),
  apart as (select distinct x.k from (select k, unnest(authors) as a from m) x join (select k, unnest(authors) as b from m) y on x.k = y.k where not contains(a, b) and not contains(b, a)),
  verdict as (select k, n, case when k in (select k from apart) then 'different authors' when len(editions) > 1 then 'different editions' when coalesce(high - low, 0) > 1 then concat('years ', low, '-', high) when len(types) > 1 then concat('different item types (', array_to_string(types, ', '), ')') else '' end as reason from m)"""


def _editions(v: Views) -> DataFrame:
    return v.items.withColumn("edition", F.expr(_EDITION))


@query("items", f", {_VERDICT} select k, n, reason = '' as confident, reason from verdict")
def merge_confidence(v: Views) -> DataFrame:
    return dedupe.group_verdicts(_editions(v))


_PLAN = f"""{_VERDICT}, plan as (select f as master, key as other, reason = '' as confident, reason from (select k, key, first_value(key) over (partition by k order by date, scan_order) as f from g) join verdict using (k) where key <> f)"""


@query("items", f", {_PLAN} select * from plan")
def merge_plan(v: Views) -> DataFrame:
    return dedupe.merge_plan(_editions(v))


@query("items", f", {_PLAN} select master, other, case when m.type <> o.type then 'merged, type changed' else 'merged' end as status from plan join items m on m.key = master join items o on o.key = other where confident")
def merge_log(v: Views) -> DataFrame:
    return dedupe.merge_log(v.items, dedupe.merge_plan(_editions(v)).where("confident"))


@query("items item_tags", f", {_PLAN} select distinct coalesce(p.master, t.item_key) as item_key, tag from item_tags t left join plan p on p.other = t.item_key and p.confident")
def merge_remap_tags(v: Views) -> DataFrame:
    return dedupe.remap_children(v.item_tags, dedupe.merge_plan(_editions(v)).where("confident"))


@query("items", f""", p as (select scan_order as probe_id, {KEY.format('title')} as p, {KEY.format("coalesce(last_name, '')")} as nm, array_to_string(list_slice(list_filter(string_split({KEY.format('title')}, ' '), lambda w: length(w) > 2), 1, 4), ' ') as phrase from items),
  i as (select key, scan_order, lower(title) as raw, {KEY.format('title')} as t, {KEY.format("coalesce(last_name, '')")} as nm from items),
  held as materialized (select probe_id, p, key, scan_order, t from p join i on contains(raw, phrase) where phrase <> '' and (p.nm = '' or p.nm = i.nm)),
  near as (select *, {SIM.format('p', 't')} as s from held)
  select probe_id, key, round(s, 6) as similarity from (select *, row_number() over (partition by probe_id order by scan_order) as k from near where s >= 0.9) where k = 1""")
def duplicate_probe(v: Views) -> DataFrame:
    return dedupe.duplicate_probe(v.items, v.items.select(F.col("scan_order").alias("probe_id"), "title", "last_name"))


# ---- tags
@query("item_tags", f"select tag, target from (select tag, first_value(tag) over (partition by lower({SQUEEZE.format('tag')}) order by (tag = lower(tag)), tag) as target from (select distinct tag from item_tags)) where tag <> target")
def tag_normalize_plan(v: Views) -> DataFrame:
    return tags.normalization_plan(v.item_tags)


@query("item_tags", f"select distinct item_key, target as tag from (select item_key, first_value(tag) over (partition by lower({SQUEEZE.format('tag')}) order by (tag = lower(tag)), tag) as target from item_tags)")
def tag_normalize_apply(v: Views) -> DataFrame:
    return tags.apply_renames(v.item_tags, tags.normalization_plan(v.item_tags))


RULES = [{"match": "europe|asia", "tags": ["#eurasia"]}, {"match": "china|japan|india", "tags": ["#asia", "#east"]}, {"match": "^united", "tags": ["#united"]}]
_RULED = f"""{_PATHS}, ip as (select item_key, path from item_collections m join paths on m.collection_key = paths.key),
  txt as (select item_key, array_to_string(list_transform(list_filter(list_transform(string_split(path, '/'), lambda s: trim(s)), lambda s: s <> '' and lower(s) <> 'asia'), lambda s: lower(s)), ' / ') as own, lower(path) as whole from ip),
  t as (select item_key, case when own <> '' then own else whole end as x from txt),
  wanted as (select distinct item_key, tag from (select item_key, '#eurasia' as tag from t where regexp_matches(x, 'europe|asia') union all select item_key, unnest(['#asia', '#east']) from t where regexp_matches(x, 'china|japan|india') union all select item_key, '#united' from t where regexp_matches(x, '^united')))"""


def _wanted(v: Views) -> DataFrame:
    return tags.tags_of_paths(catalog.item_paths(v.item_collections, v.collections), RULES, ["Asia"])


@query("collections item_collections", f", {_RULED} select * from wanted")
def tags_from_collections(v: Views) -> DataFrame:
    return _wanted(v)


@query("items collections item_collections item_tags", f", {_RULED} select tag, count(distinct item_key) as n, round(100.0 * count(distinct item_key) / (select count(*) from items), 6)::double as share, round(100.0 * count(distinct item_key) / (select count(*) from items), 6) > 40 as wide from wanted where (item_key, tag) not in (select item_key, tag from item_tags) group by tag")
def tag_gain_counts(v: Views) -> DataFrame:
    return tags.tag_gains(tags.missing_tags(_wanted(v), v.item_tags), v.items)


@query("items item_tags", """, w as (select key as item_key, unnest([upper(language), concat('by ', publisher), language]) as tag from items),
  n as (select tag, count(distinct item_key) as n from w where (item_key, tag) not in (select item_key, tag from item_tags) group by tag)
  select tag, n, round(100.0 * n / (select count(*) from items), 6)::double as share, round(100.0 * n / (select count(*) from items), 6) > 40 as wide, cast(row_number() over (order by n desc, tag) as int) as rank from n""")
def tag_gain_list(v: Views) -> DataFrame:
    wanted = v.items.select(F.col("key").alias("item_key"), F.explode(F.array(F.upper("language"), F.concat(F.lit("by "), "publisher"), F.col("language"))).alias("tag"))
    return tags.gain_list(tags.tag_gains(tags.missing_tags(wanted, v.item_tags), v.items))


@query("items", "select key, title, case when total > 100 then concat('showing 100 of ', total) else '' end as notice from (select key, title, count(*) over () as total from items order by title, key limit 100)")
def items_listed(v: Views) -> DataFrame:
    # a listing of its default length, and what it says about the rest
    rows, total = catalog.page_of(v.items.select("key", "title"), [F.col("title"), F.col("key")], catalog.LIST_LIMIT)
    return rows.withColumn("notice", F.lit(catalog.notice(min(catalog.LIST_LIMIT, total), total)))


@query("item_tags", "select distinct item_key, case when tag = 'en' then 'English' else tag end as tag from item_tags")
def tag_rename(v: Views) -> DataFrame:
    return tags.rename_tag(v.item_tags, "en", "English")


@query("items item_tags", "select distinct item_key, tag from item_tags where not (tag = 'en' and item_key in (select key from items where type = 'book')) union select key, 'read' from items where type = 'thesis'")
def tag_add_remove(v: Views) -> DataFrame:
    keys = v.items.where("type = 'book'").select("key")
    added = tags.add_tag(v.item_tags, v.items, v.items.where("type = 'thesis'").select("key").union(v.spark.sql("select 'NOSUCH' as key")), "read")
    return tags.remove_tag(added, keys, "en")


@query("item_tags", "select distinct source as tag from documents where source not in (select tag from item_tags) union select 'never used'")
def tag_purge(v: Views) -> DataFrame:
    known = v.table("documents").select(F.col("source").alias("tag")).union(v.spark.sql("select 'never used' as tag")).distinct()
    return tags.unused_tags(known, v.item_tags)


# ---- edits
_SETS = "sets as (select key, max_by(value, seq) filter (field = 'title') as title, max_by(value, seq) filter (field = 'date') as date, max_by(value, seq) filter (field = 'doi') as doi from edits group by key)"


@query("items edits", f", {_SETS} select i.key, coalesce(s.title, i.title) as title, coalesce(s.date, i.date) as date, coalesce(s.doi, i.doi) as doi from items i left join sets s using (key)")
def apply_edits(v: Views) -> DataFrame:
    return edits.apply_sets(v.items, v.edits, ["title", "date", "doi"]).select("key", "title", "date", "doi")


@query("items edits item_tags", ", ops as (select key as item_key, tag, max_by(remove_tag, seq) as gone from edits where tag is not null and key in (select key from items) group by all) select item_key, tag from item_tags where (item_key, tag) not in (select item_key, tag from ops) union select item_key, tag from ops where not gone")
def apply_tag_edits(v: Views) -> DataFrame:
    return edits.apply_tags(v.item_tags, v.edits, v.items)


@query("items edits", "select key, key in (select key from edits where trash) as trashed from items")
def apply_trash(v: Views) -> DataFrame:
    return edits.apply_trash(v.items, v.edits).select("key", "trashed")


@query("items edits", ", e as (select key, field, max_by(value, seq) as value from edits group by all) select e.key, e.field, case e.field when 'title' then title when 'date' then date else doi end as old, e.value as new from e join items using (key) where value is distinct from (case e.field when 'title' then title when 'date' then date else doi end)")
def edits_dry_run(v: Views) -> DataFrame:
    return edits.dry_run(v.items, v.edits)


@query("items edits", ", e as (select key, count(*) as n from edits group by key) select items.key, case when e.key is null and scan_order % 10 = 7 then 'kept' else title end as title, date, doi from items left join e on e.key = items.key")
def undo_roundtrip(v: Views) -> DataFrame:
    # two operations on different items; only the first one is undone
    other = v.items.where("scan_order % 10 = 7").join(v.edits, "key", "left_anti")
    second = other.select(F.col("scan_order").alias("seq"), "key", F.lit("title").alias("field"), F.lit("kept").alias("value"))
    log = edits.snapshot(v.items, v.edits, "op1").unionByName(edits.snapshot(v.items, second, "op2"))
    after = edits.apply_sets(edits.apply_sets(v.items, v.edits, ["title", "date", "doi"]), second, ["title"])
    return edits.undo(after, log, "op1").select("key", "title", "date", "doi")


@query("items item_collections", "select distinct item_key, collection_key from item_collections union select key, 'REG00002' from items where language = 'de'")
def move_items(v: Views) -> DataFrame:
    return edits.move(v.item_collections, v.items, v.collections, v.items.where("language = 'de'").select("key"), "REG00002")


@query("parents attachments", "select distinct concat('O', lpad(cast(o_orderkey * 2 as varchar), 8, '0')) as key, case when concat('O', lpad(cast(o_orderkey * 2 as varchar), 8, '0')) not in (select key from parents) then 'not-found' when concat('O', lpad(cast(o_orderkey * 2 as varchar), 8, '0')) in (select parent_key from attachments where content_type = 'application/pdf' and not deleted and parent_key is not null) then 'has-pdf' when o_orderkey % 3 = 0 then 'attached' when o_orderkey % 3 = 1 then 'error' else 'none' end as status from orders")
def pdf_fetch_status(v: Views) -> DataFrame:
    wanted = v.table("orders").select("o_orderkey", F.concat(F.lit("O"), F.lpad((F.col("o_orderkey") * 2).cast("string"), 8, "0")).alias("key")).distinct()
    fetched = wanted.where("o_orderkey % 3 < 2").select("key", (F.col("o_orderkey") % 3 == 0).alias("ok"))
    return edits.fetch_status(v.parents, v.attachments, fetched, wanted.select("key"))


# ---- enrichment
@query()
def enrich_verify(v: Views) -> DataFrame:
    return enrich.verify(v.items, v.candidates)


@query("items candidates", f""", x as (select c.item_key, c.rank, c.doi, {NORM.format('i.title')} as a, {NORM.format('c.title')} as b, cast({YEAR.format('i.date')} as int) as iy, c.year as cy, {NORM.format("regexp_extract(trim(concat(first_name, ' ', last_name)), '(\\S+)$', 1)")} as sn, {NORM.format('c.author')} as an from items i join candidates c on c.item_key = i.key),
  y as (select *, {SIM.format('a', 'b')} as s from x)
  select item_key, rank, doi, round(s, 6) as similarity, case when s < (case when iy is null and sn = '' then 0.98 else 0.92 end) then 'title' when abs(iy - cy) > 1 then 'year' when not contains(an, sn) then 'author' else 'ok' end as reason from y""")
def enrich_verify_levenshtein(v: Views) -> DataFrame:
    return enrich.verify(v.items, v.candidates, exact=False)


@query()
def enrich_pick(v: Views) -> DataFrame:
    return enrich.pick(v.items, v.candidates, "abstract")


@query()
def enrich_rejections(v: Views) -> DataFrame:
    return enrich.rejections(enrich.pick(v.items, v.candidates, "doi"))


# ---- document structure
def _re(pattern: str) -> str:
    """A pattern of the engine in DuckDB's spelling: its case folding is Unicode's already."""
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


_EDGE = r"[\s.·•․‥…‧_\-–—]"
_LED, _BARE = rf"^(.+?[^\s.·•․‥…‧_\-–—]){_EDGE}{{2,}}(\d{{1,4}}|(?i:[ivxlcdm]{{1,15}}))$", r"^(.+?\S)\s+(\d{1,4})$"
_ROMAN = "list_transform(string_split(lower({0}), ''), lambda c: case c when 'm' then 1000 when 'd' then 500 when 'c' then 100 when 'l' then 50 when 'x' then 10 when 'v' then 5 when 'i' then 1 else 0 end)"
_ROMAN_SUM = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: case when {0}[i] < coalesce({0}[i + 1], 0) then -{0}[i] else {0}[i] end))"


def _entries_of(source: str) -> str:
    """Tables that end in ``entry``: the contents entries (title, printed, roman) among the lines of ``source``."""
    words = ", ".join(f"'{w}'" for w in outline.STRUCTURAL)
    return f"""e1 as (select *, trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')) as ln from {source}),
  e2 as (select *, regexp_matches(ln, '{_LED}') as led, regexp_matches(ln, '{_BARE}') as bare from e1),
  e3 as (select *, case when led then regexp_extract(ln, '{_LED}', 1) else regexp_extract(ln, '{_BARE}', 1) end as raw_title, case when led then regexp_extract(ln, '{_LED}', 2) else regexp_extract(ln, '{_BARE}', 2) end as pg from e2 where led or bare),
  e4 as (select *, regexp_replace(raw_title, '^{_EDGE}+|{_EDGE}+$', '', 'g') as title, not regexp_matches(pg, '^[0-9]+$') as roman, {_ROMAN.format('pg')} as dg from e3),
  e5 as (select *, cast(case when roman then {_ROMAN_SUM.format('dg')} else try_cast(pg as int) end as int) as printed from e4),
  entry as (select * from e5 where length(title) >= 2 and regexp_matches(title, '\\pL') and lower(title) not in ({words}) and printed > 0 and (not roman or printed <= {outline.ROMAN_CEILING}))"""


_NUMBER = "regexp_matches(trim({0}), '^(?:[0-9]{{1,4}}|(?i:[ivxlcdm]{{1,15}}))$')"


def _paired_of(source: str) -> str:
    """Tables that end in ``paired``: each number of a page, in reading order, takes the right-most free title left of it whose box
    holds its middle. The choice is a recursion over a page's numbers."""
    return f"""p1 as (select n.doc_id, n.page, n.ord as number_ord, trim(n.text) as printed, list(t.ord order by t.x1 desc, t.ord) as titles
    from (select * from {source} where {_NUMBER.format('text')}) n join (select * from {source} where not {_NUMBER.format('text')}) t on n.doc_id = t.doc_id and n.page = t.page and t.x1 <= n.x0 + 2 and (n.y + n.y1) / 2 between t.y - 1 and t.y1 + 1 group by n.doc_id, n.page, n.ord, n.text),
  p2 as (select *, row_number() over (partition by doc_id, page order by number_ord) as k from p1),
  p3 as (select doc_id, page, 0::bigint as k, []::bigint[] as taken, null::bigint as ord, null::bigint as number_ord, null::varchar as printed from p2 where k = 1
    union all select doc_id, page, k, case when free is null then taken else list_append(taken, free) end, free, number_ord, printed from (select p2.doc_id, p2.page, p2.k, p2.number_ord, p2.printed, p3.taken, list_filter(p2.titles, lambda c: not list_contains(p3.taken, c))[1] as free
      from p3 join p2 on p2.doc_id = p3.doc_id and p2.page = p3.page and p2.k = p3.k + 1)),
  paired as (select p3.doc_id, p3.page, p3.ord, l.text as title, p3.number_ord, p3.printed from p3 join {source} l on l.doc_id = p3.doc_id and l.ord = p3.ord)"""


def _listed(source: str) -> str:
    """Tables that end in ``listed`` (contents pages) and ``runs`` (of them)."""
    return f"""{_entries_of(source)}, {_paired_of(source)},
  n1 as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from {source}),
  n2 as (select doc_id, page, count(*) as n, count(*) filter (regexp_matches(t, '{_re(outline.EXHIBIT_ROW)}')) as exhibits, substr(string_agg(t, chr(10) order by ord), 1, {outline.HEAD}) as head from n1 where t <> '' group by all),
  n3 as (select n2.*, coalesce(c.printed, 0) as printed, coalesce(q.pairs, 0) as pairs, regexp_matches(head, '{_re(outline.CONTENTS)}') as titled, z.page_count from n2 join (select doc_id, max(page) as page_count from {source} group by doc_id) z on z.doc_id = n2.doc_id
    left join (select doc_id, page, count(*) as printed from entry group by all) c on c.doc_id = n2.doc_id and c.page = n2.page left join (select doc_id, page, count(*) as pairs from paired group by all) q on q.doc_id = n2.doc_id and q.page = n2.page
    where not regexp_matches(head, '{_re(outline.EXHIBIT_LIST)}') and not (exhibits >= {outline.EXHIBIT_ROWS} or (exhibits >= 2 and exhibits / n > {outline.EXHIBIT_SHARE}))),
  n4 as (select *, case when titled and printed < {outline.LEAST_ROWS} then pairs else printed end as rows from n3 where page <= greatest(4, floor(page_count * {outline.FRONT}))),
  listed as (select doc_id, page, rows, titled from n4 where rows >= {outline.LEAST_ROWS} and (titled or rows / n > {outline.DENSE})),
  r1 as (select *, page - row_number() over (partition by doc_id order by page) as island from listed),
  r2 as (select doc_id, min(page) as first, max(page) as last, bool_or(titled) as titled from r1 group by doc_id, island),
  runs as (select doc_id, first, last, titled from (select *, bool_or(titled) over (partition by doc_id) as anyt, row_number() over (partition by doc_id order by first) as k from r2) where titled or (not anyt and k = 1))"""


@query("pdf_lines", f""", numbered as (select doc_id, ord, concat(text, case when ord % 3 = 0 then ' ..... ' else ' ' end, case when ord % 5 = 0 then concat(repeat('x', (ord + 1) // 10), ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(ord + 1) % 10 + 1]) else cast(ord + 1 as varchar) end) as text from pdf_lines),
  {_entries_of('numbered')} select doc_id, ord, title, printed, roman from entry""")
def toc_parse_lines(v: Views) -> DataFrame:
    # numbers in tens and units; of 40 and more the tens are not what a reader writes, but they are read as well
    roman = F.concat(F.repeat(F.lit("x"), F.floor((F.col("ord") + 1) / 10).cast("int")), F.get(F.array(*(F.lit(x) for x in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))), ((F.col("ord") + 1) % 10).cast("int")))
    numbered = v.pdf_lines.withColumn("line", F.concat("text", F.when(F.col("ord") % 3 == 0, " ..... ").otherwise(" "), F.when(F.col("ord") % 5 == 0, roman).otherwise((F.col("ord") + 1).cast("string"))))
    return numbered.withColumn("e", outline.contents_line("line")).where("e is not null").select("doc_id", "ord", "e.title", "e.printed", "e.roman")


@query("audit", """, a as (select event_id, cast(event_id % 3999 + 1 as int) as i from audit)
  select event_id, i as n, concat(repeat('m', i // 1000), ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][i // 100 % 10 + 1], ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][i // 10 % 10 + 1], ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][i % 10 + 1]) as roman, i as back from a""")
def roman_values(v: Views) -> DataFrame:
    n = v.audit.select("event_id", (F.col("event_id") % 3999 + 1).cast("int").alias("n")).withColumn("roman", T.roman_text("n"))
    return n.withColumn("back", T.roman_value("roman").cast("int"))


# contents entries of documents: their lines, printed page = page - doc_id % 5 where known
_ENTRIES = "select doc_id, ord, cast(page - doc_id % 5 as int) as printed, (ord % 6 = 3) as roman, page, text as title from {pdf_lines} where page - doc_id % 5 > 0"


def _entries(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = v.sql(_ENTRIES, pdf_lines=v.pdf_lines)
    labels = e.where("ord % 4 = 0 and not roman").groupBy("doc_id", F.col("printed").cast("string").alias("label")).agg(F.min("page").alias("page"))
    folio = e.where("ord % 12 = 3").groupBy("doc_id", F.lit("r").alias("series"), F.col("printed").alias("n")).agg(F.min("page").alias("page"))
    count = v.pdf_lines.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    return e.select("doc_id", "ord", "printed", "roman"), labels, folio, count


_EV = """e as (select doc_id, ord, cast(page - doc_id % 5 as int) as printed, (ord % 6 = 3) as roman, page from pdf_lines where page - doc_id % 5 > 0),
  lab as (select doc_id, printed, min(page) as page from e where ord % 4 = 0 and not roman group by all), fol as (select doc_id, printed, min(page) as page from e where ord % 12 = 3 group by all), cnt as (select doc_id, max(page) as page_count from pdf_lines group by doc_id),
  f as (select e.doc_id, e.ord, e.printed, e.roman, case when not e.roman then lab.page end as by_label, case when e.roman then fol.page end as by_folio from e left join lab on e.doc_id = lab.doc_id and e.printed = lab.printed left join fol on e.doc_id = fol.doc_id and e.printed = fol.printed),
  vote as (select doc_id, delta from (select doc_id, delta, row_number() over (partition by doc_id order by n desc, first) as k from (select doc_id, by_label - printed as delta, count(*) as n, min(ord) as first from f where by_label is not null and not roman group by all)) where k = 1)"""


@query("pdf_lines", f", {_EV} select f.doc_id, ord, cast(least(greatest(coalesce(by_label, by_folio, case when not roman then printed + delta end), 1), page_count) as int) as page, case when by_label is not null then 'labels' when by_folio is not null then 'folio' when not roman and delta is not null then 'voted' else 'none' end as confidence from f left join vote using (doc_id) left join cnt on cnt.doc_id = f.doc_id where coalesce(by_label, by_folio, case when not roman then printed + delta end) is not null union all select f.doc_id, ord, null, 'none' from f left join vote using (doc_id) where coalesce(by_label, by_folio, case when not roman then printed + delta end) is null")
def toc_resolve_pages(v: Views) -> DataFrame:
    return outline.resolve_pages(*_entries(v))


@query("pdf_lines", f", {_EV} select doc_id, cast(delta as int) as \"offset\" from vote")
def toc_vote_offset(v: Views) -> DataFrame:
    e, labels, _, _ = _entries(v)
    both = e.where("not roman").join(labels, (e.doc_id == labels.doc_id) & (e.printed.cast("string") == labels.label)).select(e.doc_id, "ord", "printed", F.col("page").alias("physical"))
    return outline.offset_votes(both)


@query("pdf_lines", """recursive:, x as (select doc_id, ord, x0 + ord % 7 * 1.5 as x0 from pdf_lines),
  b as (select doc_id, min(x0) as base from x group by doc_id union all select b.doc_id, (select min(x0) from x where x.doc_id = b.doc_id and x.x0 > b.base + 4) from b where exists (select 1 from x where x.doc_id = b.doc_id and x.x0 > b.base + 4))
  select x.doc_id, x.ord, cast(least(greatest((select count(*) from b where b.doc_id = x.doc_id and x.x0 >= b.base - 4), 1), 6) as int) as level from x""")
def toc_levels_from_indents(v: Views) -> DataFrame:
    return outline.indented(v.pdf_lines.select("doc_id", "ord", (F.col("x0") + F.col("ord") % 7 * 1.5).alias("x0")), ["doc_id"]).select("doc_id", "ord", "level")


@query("pdf_lines", f""", a as (select doc_id, ord, least(1 + ord % 4 * 2, 4) as level, {SQUEEZE.format('text')} as title, greatest(page * 2 - ord % 3, 1) as page from pdf_lines),
  b as (select * from a where title <> '' qualify row(level, title, page) is distinct from lag(row(level, title, page)) over (partition by doc_id order by ord)),
  c as (select *, row_number() over (partition by doc_id order by ord) - 1 as i from b),
  d as (select doc_id, i, i + least(1, min(level - i) over (partition by doc_id order by i)) as level, title, page from c),
  e as (select *, page < lag(page) over (partition by doc_id order by i) as back from d)
  select doc_id, cast(i as int) as i, cast(level as int) as level, title, cast(page as int) as page, count(*) filter (back) over (partition by doc_id) as n_backwards from e""")
def outline_normalize(v: Views) -> DataFrame:
    entries = v.pdf_lines.select("doc_id", "ord", (1 + F.col("ord") % 4 * 2).cast("int").alias("level"), F.col("text").alias("title"), (F.col("page") * 2 - F.col("ord") % 3).cast("int").alias("page"))
    out = outline.normalize_rows(entries, None, 4)
    back = F.col("page") < F.lag("page").over(Window.partitionBy("doc_id").orderBy("i"))
    return out.withColumn("back", back).withColumn("n_backwards", F.count_if("back").over(Window.partitionBy("doc_id"))).drop("back")


@query()
def outline_text_roundtrip(v: Views) -> DataFrame:
    row = F.struct("ord", (1 + F.col("ord") % 3).cast("int").alias("level"), T.squeeze(F.regexp_replace("text", "[#\\t]", "")).alias("title"), "page")
    doc = v.pdf_lines.where("length(trim(text)) > 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    entries = F.transform(F.filter("r", lambda x: x["title"] != ""), lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page")))
    back = outline.parse(outline.render(F.col("e")))
    return doc.withColumn("e", entries).select("doc_id", F.size("e").alias("n"), (back == F.col("e")).alias("same"))


@query("pdf_lines", "select doc_id, size as body from (select doc_id, size, row_number() over (partition by doc_id order by sum(length(text)) desc, size) as k from pdf_lines group by doc_id, size) where k = 1")
def body_font_size(v: Views) -> DataFrame:
    return outline.body_size(v.pdf_lines)


@query("pdf_lines", """, b as (select doc_id, size as body from (select doc_id, size, row_number() over (partition by doc_id order by sum(length(text)) desc, size) as k from pdf_lines group by doc_id, size) where k = 1)
  select doc_id, w as measure from (select l.doc_id, x1 - x0 as w, row_number() over (partition by l.doc_id order by x1 - x0, ord) - 1 as k, count(*) over (partition by l.doc_id) as n from pdf_lines l join b on b.doc_id = l.doc_id where abs(size - body) <= 0.5) where k = least(floor(n * 0.9), n - 1)""")
def text_measure(v: Views) -> DataFrame:
    return outline.text_measure(v.pdf_lines, outline.body_size(v.pdf_lines))


@query("pdf_lines", "select doc_id, lower(trim(text)) as head from pdf_lines group by all having count(distinct page) >= 3")
def running_heads(v: Views) -> DataFrame:
    return outline.running_heads(v.pdf_lines)


_SCORE = f"""case when y < 0.06 * page_height or y > 0.93 * page_height or length(t) < 3 or length(t) > 110 or len(regexp_split_to_array(t, '\\s+')) > 20 or regexp_matches(t, '{_re(outline.CAPTION)}') or size < body - 0.4 or regexp_matches(t, '{_re(outline.PROSE)}')
    or (size < body * 1.35 and measure > 0 and x1 - x0 > 0.85 * measure) then 0 else (case when size > 1.12 * body then 3 else 0 end) + (case when size > 1.35 * body then 2 else 0 end) + (case when bold and size >= body then 2 else 0 end) + (case when regexp_matches(t, '{_re(outline.NUMBERED)}') then 3 else 0 end)
    + (case when t = upper(t) and t <> lower(t) and length(t) > 4 then 1 else 0 end) + (case when lines_in_block <= 2 then 1 else 0 end) + (case when not regexp_matches(t, '[.,;:]$') then 1 else 0 end) + (case when abs((x0 + x1) / 2 - page_width / 2) < 0.04 * page_width then 1 else 0 end) end"""


@query("pdf_lines", f""", b as (select doc_id, size as body from (select doc_id, size, row_number() over (partition by doc_id order by sum(length(text)) desc, size) as k from pdf_lines group by doc_id, size) where k = 1),
  w as (select l.doc_id, x1 - x0 as w, row_number() over (partition by l.doc_id order by x1 - x0, ord) - 1 as k, count(*) over (partition by l.doc_id) as n from pdf_lines l join b on b.doc_id = l.doc_id where abs(size - body) <= 0.5),
  x as (select l.*, trim(text) as t, body, coalesce(m.w, 0) as measure from pdf_lines l join b on b.doc_id = l.doc_id left join (select * from w where k = least(floor(n * 0.9), n - 1)) m on m.doc_id = l.doc_id)
  select doc_id, ord, cast({_SCORE} as int) as score from x""")
def heading_scores(v: Views) -> DataFrame:
    return outline.scored_lines(v.pdf_lines).select("doc_id", "ord", "score")


@query()
def heading_candidates(v: Views) -> DataFrame:
    return outline.heading_candidates(v.pdf_lines)


@query()
def heading_levels(v: Views) -> DataFrame:
    return outline.heading_levels(outline.heading_candidates(v.pdf_lines))


@query()
def verify_toc_pages(v: Views) -> DataFrame:
    e, labels, folio, count = _entries(v)
    placed = outline.resolve_pages(e, labels, folio, count).where("page is not null").join(v.sql(_ENTRIES, pdf_lines=v.pdf_lines).select("doc_id", "ord", "title", "printed", "roman"), ["doc_id", "ord"])
    pages = v.pdf_lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    verified = written(outline.verify_pages(written(placed, "placed"), pages), "verified")
    return outline.repair_pages(verified, pages).select("doc_id", "ord", "page", "confidence")


@query("column_lines", f"recursive:, {_listed('column_lines')} select * from listed")
def contents_pages(v: Views) -> DataFrame:
    return outline.contents_pages(v.column_lines)


@query("column_lines", f"recursive:, {_listed('column_lines')} select * from runs")
def contents_runs(v: Views) -> DataFrame:
    return outline.contents_runs(outline.contents_pages(written(v.column_lines, "lines")))


def _joined(head: str, tail: str) -> str:
    return f"case when regexp_matches({head}, '(^|[^-])-$') then concat(substr({head}, 1, length({head}) - 1), {tail}) else concat({head}, ' ', {tail}) end"


_AT_START = _re(outline.CONTENTS).replace(r"\b(", "^(", 1)
_BELOW = "{0}.page = {1}.page and {0}.y - {1}.y > 0 and {0}.y - {1}.y <= 1.8 * greatest({1}.y1 - {1}.y, 1)"


@query("column_lines", f"""recursive:, {_listed('column_lines')}, o0 as (select l.doc_id, r.first, l.page, l.ord, trim(l.text) as line, l.y, l.y1, l.x0, e.title, e.printed, e.roman, row_number() over (partition by l.doc_id, r.first order by l.page, l.ord) as k,
    e.title is null and length(trim(l.text)) between 2 and 120 and not regexp_matches(trim(l.text), '{_AT_START}') as pending from column_lines l join runs r on r.doc_id = l.doc_id and l.page between r.first and r.last left join entry e on e.doc_id = l.doc_id and e.ord = l.ord),
  o1 as (select a.doc_id, a.first, a.page, a.ord, a.title, a.printed, a.roman, a.x0, count(*) over (partition by a.doc_id, a.first) as n, b.line as l1, c.line as l2, d.line as l3, b.x0 as x1, c.x0 as x2, d.x0 as x3,
      coalesce(regexp_matches(a.title, '^\\p{{Ll}}') and b.pending and {_BELOW.format('a', 'b')}, false) as g1, coalesce(regexp_matches(b.line, '^\\p{{Ll}}') and c.pending and {_BELOW.format('b', 'c')}, false) as g2, coalesce(regexp_matches(c.line, '^\\p{{Ll}}') and d.pending and {_BELOW.format('c', 'd')}, false) as g3
    from o0 a left join o0 b on b.doc_id = a.doc_id and b.first = a.first and b.k = a.k - 1 left join o0 c on c.doc_id = a.doc_id and c.first = a.first and c.k = a.k - 2 left join o0 d on d.doc_id = a.doc_id and d.first = a.first and d.k = a.k - 3
    where a.title is not null and not regexp_matches(a.title, '{_AT_START}')),
  w1 as (select *, {_joined('l1', 'title')} as t1 from o1), w2 as (select *, {_joined('l2', 't1')} as t2 from w1), w3 as (select *, {_joined('l3', 't2')} as t3 from w2),
  c0 as (select l.doc_id, r.first, l.page, l.ord, trim(l.text) as line, l.y, l.y1, l.x0, p.printed as pg, p.printed is null and not {_NUMBER.format('l.text')} as free, count(p.printed) over (partition by l.doc_id, r.first, l.page) as n, row_number() over (partition by l.doc_id, r.first, l.page order by l.ord) as k
    from column_lines l join runs r on r.doc_id = l.doc_id and l.page between r.first and r.last left join paired p on p.doc_id = l.doc_id and p.ord = l.ord where not exists (select 1 from o1 where o1.doc_id = r.doc_id and o1.first = r.first and o1.n >= 4)),
  c1 as (select a.doc_id, a.first, a.page, a.ord, a.line as title, a.pg, not regexp_matches(a.pg, '^[0-9]+$') as roman, {_ROMAN.format('a.pg')} as dg, a.x0, b.line as l1, c.line as l2, d.line as l3, b.x0 as x1, c.x0 as x2, d.x0 as x3,
      coalesce(b.free and {_BELOW.format('a', 'b')}, false) as g1, coalesce(c.free and {_BELOW.format('b', 'c')}, false) as g2, coalesce(d.free and {_BELOW.format('c', 'd')}, false) as g3
    from c0 a left join c0 b on b.doc_id = a.doc_id and b.page = a.page and b.k = a.k - 1 left join c0 c on c.doc_id = a.doc_id and c.page = a.page and c.k = a.k - 2 left join c0 d on d.doc_id = a.doc_id and d.page = a.page and d.k = a.k - 3
    where a.pg is not null and a.n >= 4 and length(a.line) >= 2 and not regexp_matches(a.line, '{_AT_START}')),
  v1 as (select *, cast(case when roman then {_ROMAN_SUM.format('dg')} else try_cast(pg as int) end as int) as printed, {_joined('l1', 'title')} as t1 from c1), v2 as (select *, {_joined('l2', 't1')} as t2 from v1), v3 as (select *, {_joined('l3', 't2')} as t3 from v2 where printed > 0 and (not roman or printed <= {outline.ROMAN_CEILING})),
  every as (select doc_id, first, page, ord, title, t1, t2, t3, g1, g2, g3, printed, roman, x0, x1, x2, x3 from w3 where n >= 4 or not exists (select 1 from v3 where v3.doc_id = w3.doc_id and v3.first = w3.first)
    union all select doc_id, first, page, ord, title, t1, t2, t3, g1, g2, g3, printed, roman, x0, x1, x2, x3 from v3)
  select doc_id, first, page, ord, case when g1 and g2 and g3 then t3 when g1 and g2 then t2 when g1 then t1 else title end as title, printed, roman, case when g1 and g2 and g3 then x3 when g1 and g2 then x2 when g1 then x1 else x0 end as x0 from every""")
def printed_contents(v: Views) -> DataFrame:
    lines = written(v.column_lines, "lines")
    runs = written(outline.contents_runs(outline.contents_pages(lines)), "runs")
    return outline.printed_contents(runs, lines)


@query()
def linked_contents(v: Views) -> DataFrame:
    return outline.linked_contents(v.links, v.toc_lines)


_GLUED = "select doc_id, ord, case when ord % 4 = 0 then concat(text, cast(ord + 3 as varchar(20))) when ord % 4 = 1 then concat(text, ' 19', cast(50 + ord % 50 as varchar(20))) else text end as title, cast(case when ord % 4 > 1 then ord + 1 + (case when ord % 13 = 2 then 1 else 0 end) end as int) as printed, (ord % 11 = 3) as roman, cast(ord + 7 - ord % 4 as int) as link_page from {toc_lines}"


@query("toc_lines", f""", t as ({_GLUED.format(toc_lines='toc_lines')}),
  agreed as (select doc_id, delta, n from (select doc_id, link_page - printed as delta, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, min(ord)) as k from t where printed is not null and not roman group by doc_id, link_page - printed) where k = 1 and n >= 3),
  u as (select t.*, delta, regexp_extract(title, '(?s)^(.*?[\\p{{L}}\\p{{Nl}}\\p{{No}}])\\s*(\\d{{1,4}})$', 1) as head, try_cast(regexp_extract(title, '(?s)^(.*?[\\p{{L}}\\p{{Nl}}\\p{{No}}])\\s*(\\d{{1,4}})$', 2) as int) as tail from t left join agreed on agreed.doc_id = t.doc_id)
  select doc_id, ord, case when printed is null and tail + delta = link_page then trim(head) else title end as title, case when printed is null and tail + delta = link_page then tail else printed end as printed from u""")
def glued_numbers(v: Views) -> DataFrame:
    return outline.glued_numbers(v.sql(_GLUED, toc_lines=v.toc_lines)).select("doc_id", "ord", "title", "printed")


@query("column_lines", f"recursive:, {_paired_of('column_lines')} select * from paired")
def paired_columns(v: Views) -> DataFrame:
    return outline.pair_columns(v.column_lines)


@query("pdf_lines", """, c as (select doc_id, max(page) as n from pdf_lines group by doc_id),
  x as (select doc_id, unnest(range(0, n)) as i from c),
  l as (select doc_id, i + 1 as page, case when i < 2 then ['i', 'ii'][i + 1] when i < 4 then cast(i - 1 as varchar) when doc_id % 2 = 0 then concat('A-', cast(i - 3 as varchar)) else repeat(chr(cast(97 + (i + 19) % 26 as int)), cast((i + 19) // 26 + 1 as int)) end as label from x)
  select doc_id, label, cast(min(page) as int) as page from l group by all""")
def page_label_map(v: Views) -> DataFrame:
    count = v.pdf_lines.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    row = lambda start, style, prefix, first: F.struct(F.lit(start).alias("start"), style.alias("style"), prefix.alias("prefix"), first.alias("first"))
    even = F.col("doc_id") % 2 == 0
    third = row(4, F.when(even, "D").otherwise("a"), F.when(even, "A-"), F.when(even, 1).otherwise(24))
    ranges = count.select("doc_id", F.explode(F.array(row(0, F.lit("r"), F.lit(None).cast("string"), F.lit(1)), row(2, F.lit("D"), F.lit(""), F.lit(1)), third)).alias("r")).select("doc_id", "r.*")
    return outline.page_labels(ranges, count)


@query("pdf_lines", f""", f1 as (select doc_id, page, unnest(regexp_split_to_array(trim(case when y < 57 then concat('page ', cast(page as varchar)) else text end), '\\s+')) as t from pdf_lines where y < 0.09 * page_height or y1 > 0.91 * page_height),
  f2 as (select *, regexp_matches(t, '^[0-9]{{1,4}}$') as arabic, regexp_matches(t, '^(?i:[ivxlcdm]{{1,15}})$') as rom, {_ROMAN.format('t')} as dg from f1 where length(t) between 1 and 5),
  f3 as (select doc_id, page, case when arabic then 'd' else 'r' end as series, cast(case when arabic then try_cast(t as int) when rom and {_ROMAN_SUM.format('dg')} between 1 and {outline.ROMAN_CEILING} then {_ROMAN_SUM.format('dg')} end as int) as n from f2)
  select doc_id, series, n, min(page) as page from f3 where n > 0 group by all""")
def folio_map(v: Views) -> DataFrame:
    edge = v.pdf_lines.withColumn("text", F.when(F.col("y") < 57, F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise(F.col("text")))
    return outline.folios(edge)


@query("pdf_lines", """, d as (select doc_id, count(*) as n, max(page) as last from pdf_lines group by doc_id) select doc_id, case when doc_id % 4 = 1 then 0 when doc_id % 4 = 2 then 1 else n end as n, case when doc_id % 4 = 1 then null when doc_id % 4 = 2 then 7 else last end as last_page from d""")
def outlines_set_and_cleared(v: Views) -> DataFrame:
    entry = F.struct(F.lit(1).alias("level"), F.col("text").alias("title"), F.col("page").alias("page"))
    old = v.pdf_lines.groupBy("doc_id").agg(F.collect_list(entry).alias("entries"))
    new = old.where("doc_id % 4 = 2").select("doc_id", F.array(F.struct(F.lit(1).alias("level"), F.lit("All").alias("title"), F.lit(7).alias("page"))).alias("entries"))
    done = outline.clear_outlines(outline.set_outlines(old, new), old.where("doc_id % 4 = 1").select("doc_id"))
    return done.select("doc_id", F.size("entries").cast("long").alias("n"), F.array_max(F.transform("entries", lambda e: e["page"])).alias("last_page"))


@query()
def outline_auto(v: Views) -> DataFrame:
    lines = written(v.pdf_lines.drop("text").join(v.toc_lines.select("doc_id", "ord", "text"), ["doc_id", "ord"]), "lines")
    return outline.auto_outline(lines, v.links.where("doc_id % 6 = 0"))


@query(sql="select doc_id, case when n_chars < 100 then 'ocr-needed' when doc_id % 5 = 0 then 'contents-links' when doc_id % 7 = 0 then 'contents-printed-numbers' when doc_id % 2 = 0 then 'typography' else 'nothing-found' end as route from documents")
def outline_route(v: Views) -> DataFrame:
    zero = lambda n: F.when(F.col("doc_id") % n == 0, 3).otherwise(0)
    return outline.route(v.table("documents").select("doc_id", (F.col("n_chars") >= 100).alias("has_text"), zero(5).alias("links"), zero(7).alias("printed"), zero(2).alias("headings")))


# ---- scanned books
_SMOOTH = "sm as (select doc_id, i, case when count(*) over (partition by doc_id) < 5 then ink else avg(ink) over (partition by doc_id order by i rows between 2 preceding and 2 following) end as ink from ink)"


@query("ink", f", {_SMOOTH} select doc_id, i, round(ink, 9) as ink from sm")
def gutter_smooth(v: Views) -> DataFrame:
    return scan_prep.smooth(v.ink, 5).withColumn("ink", F.round("ink", 9))


@query("ink", """, w as (select *, count(*) over (partition by doc_id) as width from ink),
  lvl as (select *, min(ink) over (partition by doc_id) as lo, max(ink) over (partition by doc_id) as hi from w where width >= 8 and i >= floor(width * (0.5 - 0.18)) and i < ceil(width * (0.5 + 0.18))),
  q as (select *, i - row_number() over (partition by doc_id order by i) as isl from lvl where hi - lo >= 0.01 and ink <= lo + 0.25 * (hi - lo)),
  r as (select doc_id, width, min(i) as start, count(*) as length from q group by doc_id, width, isl)
  select doc_id, start, length, round((start + length / 2.0) / width, 6)::double as cut from (select *, row_number() over (partition by doc_id order by length desc, start) as k from r) where k = 1""")
def gutter_longest_run(v: Views) -> DataFrame:
    return scan_prep.gutter(v.ink)


@query("gutters", """, u as (select * from gutters where cut is not null and ink >= 0.03), m as (select doc_id, median(cut) as mid from u group by doc_id),
  c as (select u.doc_id, any_value(mid) as cut, avg(case when abs(cut - mid) <= 0.02 + 1e-12 then 1 else 0 end) as confidence from u join m on m.doc_id = u.doc_id group by u.doc_id)
  select d.doc_id, round(c.cut, 6) as cut, round(coalesce(confidence, 0), 6) as confidence from (select distinct doc_id from gutters) d left join c on c.doc_id = d.doc_id""")
def gutter_choice(v: Views) -> DataFrame:
    return scan_prep.choose_gutter(v.gutters)


@query(sql="select doc_id, len(list_distinct(list_concat([x for x in range(1 + doc_id % 9, 4 + doc_id % 9) if x <= 8], [x for x in range(2, 3 + doc_id % 4) if x <= 8]))) as n, list_sum(list_distinct(list_concat([x for x in range(1 + doc_id % 9, 4 + doc_id % 9) if x <= 8], [x for x in range(2, 3 + doc_id % 4) if x <= 8])))::bigint as total from documents")
def page_set_parse(v: Views) -> DataFrame:
    spec = F.concat_ws(",", F.concat((F.col("doc_id") % 9 + 3).cast("string"), F.lit("-"), (F.col("doc_id") % 9 + 1).cast("string")), F.concat(F.lit("2-"), (F.col("doc_id") % 4 + 2).cast("string")))
    pages = scan_prep.page_set(spec, F.lit(8))
    return v.table("documents").select("doc_id", F.size(pages).cast("long").alias("n"), F.when(F.size(pages) > 0, F.aggregate(pages, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query(sql="select doc_id as id, case when doc_id % 10 = 0 then 'lat' when lang in ('en', 'de', 'fr') then case lang when 'en' then 'eng' when 'de' then 'deu' else 'fra' end else 'eng' end as pack from documents")
def language_pick(v: Views) -> DataFrame:
    packs = v.spark.sql("select * from values ('e', 'equ'), ('en', 'eng'), ('de', 'deu'), ('fr', 'fra') as t(prefix, pack)").where("prefix <> 'e'")
    asked = v.table("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "lat").otherwise("").alias("requested"), F.col("lang").alias("language"))
    return scan_prep.pick_language(asked, packs)


@query("gutters", """, u as (select * from gutters where cut is not null and ink >= 0.03), m as (select doc_id, median(cut) as mid from u group by doc_id),
  c as (select u.doc_id, any_value(mid) as cut, avg(case when abs(cut - mid) <= 0.02 + 1e-12 then 1 else 0 end) as confidence from u join m on m.doc_id = u.doc_id group by u.doc_id)
  select d.doc_id, case when d.doc_id % 17 = 0 then 'already-processed' when d.doc_id % 2 = 0 then 'whole' when c.cut is not null and round(confidence, 6) >= 0.6 then 'split' else 'no-gutter' end as decision from (select distinct doc_id from gutters) d left join c on c.doc_id = d.doc_id""")
def scan_decisions(v: Views) -> DataFrame:
    facts = scan_prep.choose_gutter(v.gutters).withColumns({"width": F.when(F.col("doc_id") % 2 == 0, 420.0).otherwise(840.0), "height": F.lit(640.0), "processed": F.col("doc_id") % 17 == 0})
    return scan_prep.decide(facts).select("doc_id", "decision")


@query("gutters", f""", h as (select doc_id, page, unnest(case when cut is null or page % 5 = 0 then [{{'half': 0, 'x0': 0.0::double, 'x1': 1.0::double}}]
    else [{{'half': case when doc_id % 2 = 0 then 1 else 0 end, 'x0': 0.0::double, 'x1': least(cut + {scan_prep.OVERLAP}, 1.0)::double}}, {{'half': case when doc_id % 2 = 0 then 0 else 1 end, 'x0': greatest(cut - {scan_prep.OVERLAP}, 0.0)::double, 'x1': 1.0::double}}] end) as h from gutters)
  select doc_id, cast(row_number() over (partition by doc_id order by page, h.half) - 1 as int) as out, page, round(h.x0, 6) as x0, round(h.x1, 6) as x1 from h""")
def split_plan(v: Views) -> DataFrame:
    pages = v.gutters.withColumn("single", F.col("page") % 5 == 0)
    return scan_prep.split_plan(pages.where("doc_id % 2 = 0"), rtl=True).unionByName(scan_prep.split_plan(pages.where("doc_id % 2 = 1")))


@query()
def scan_from_pixels(v: Views) -> DataFrame:
    # a text's bytes as the grey pixels of pages of 40 by 32; every page is measured, no text is cut off
    data = F.encode(F.col("text"), "utf-8")
    pages = v.table("documents").where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 1280).cast("int"))).alias("page"), data.alias("data"))
    rasters = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.lit(40).alias("width"), F.lit(32).alias("height"), F.expr("substring(data, page * 1280 + 1, 1280)").alias("samples"))
    facts = scan_prep.choose_gutter(written(scan_prep.measured(rasters, 3), "pages")).withColumns({"width": F.lit(840.0), "height": F.lit(640.0), "processed": F.lit(False)})
    return facts.select("doc_id", "confidence").join(scan_prep.decide(facts), "doc_id")


@query("pdf_lines", """, p as (select doc_id, page, sum(length(text)) as chars, case when page % 4 = 0 then 840.0 else 420.0 end as width, 640.0 as height from pdf_lines group by doc_id, page),
  c as (select doc_id, width, height, row_number() over (partition by doc_id order by count(*) desc, min(page)) as k from p where page <= 12 group by doc_id, width, height)
  select c.doc_id, c.width::double as width, c.height::double as height, avg(chars) >= 80 as has_text from c join p on p.doc_id = c.doc_id where k = 1 group by all""")
def page_sizes(v: Views) -> DataFrame:
    pages = v.pdf_lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    return scan_prep.page_sizes(pages.withColumns({"width": F.when(F.col("page") % 4 == 0, 840.0).otherwise(420.0), "height": F.lit(640.0)}))


@query("gutters", "select doc_id, min_by(cast(round((1000 + page % 700) / 420.0 * 72) as int), page) as dpi from (select doc_id, page % 50 as page from gutters) where page <= 4 and page % 2 = 1 group by doc_id")
def image_dpi(v: Views) -> DataFrame:
    pages = v.gutters.select("doc_id", (F.col("page") % 50).alias("page"))
    return scan_prep.image_dpi(pages.withColumns({"image_px": F.when(F.col("page") % 2 == 1, 1000 + F.col("page") % 700).otherwise(0), "width": F.lit(420.0)}))


@query(sql="select doc_id, len(list_distinct([cast(case when n_chars <= 24 then i else floor(n_chars * 0.1) + floor(i * (floor(n_chars * 0.9) - floor(n_chars * 0.1)) / 24) end as int) for i in range(0, case when n_chars <= 24 then n_chars else 24 end)])) as n from documents")
def sampled_pages(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.size(scan_prep.sample_pages(F.col("n_chars").cast("int"), 24)).cast("long").alias("n"))


@query("attachments notes", "select distinct a.key, case when deleted then 'already-deleted' when annotations > 0 then 'kept-annotated' else 'prune' end as status from attachments a")
def prune_plan(v: Views) -> DataFrame:
    notes = v.attachments.select(F.concat(F.lit('<p>made by prep {"replaces": "'), F.col("key"), F.lit('"}</p>')).alias("text"))
    return storage.prune_plan(v.attachments, notes).distinct()


# ---- calls of the library
@query("audit", "select label, count(*) filter (regexp_matches(concat('item.', label, '(1)'), '\\.(save|erase|trash)\\(')) as n from audit group by label")
def write_calls(v: Views) -> DataFrame:
    return v.audit.withColumn("w", T.writes(F.concat(F.lit("item."), "label", F.lit("(1)")))).groupBy("label").agg(F.count_if("w").alias("n"))


@query(sql="select page_id, regexp_matches(url, '^[a-z]+://(localhost|127\\.0\\.0\\.1)([:/]|$)') as loopback from pages")
def loopback_urls(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.is_loopback("url").alias("loopback"))


@query(sql="select o_custkey as identifier, min_by(o_orderpriority, o_orderkey) filter (o_orderstatus = 'O') as translator, min_by(o_orderkey, o_orderkey) filter (o_orderstatus = 'O') as result, count(*) as attempts from orders group by o_custkey")
def first_success(v: Views) -> DataFrame:
    o = v.table("orders")
    return edits.first_success(o.select(F.col("o_custkey").alias("identifier"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("translator"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("result")))


@query("items", f"select scan_order as id, doi, title, cast({YEAR.format('date')} as int) as year, last_name as author from items")
def decode_records(v: Views) -> DataFrame:
    record = F.to_json(F.struct(F.upper("doi").alias("DOI"), F.array("title").alias("title"), F.struct(F.array(F.array(T.year_of("date"))).alias("date-parts")).alias("issued"), F.array(F.struct(F.col("last_name").alias("family"))).alias("author"), F.col("abstract")))
    got = enrich.decode_a(v.items.select(F.col("scan_order").alias("id"), record.alias("json")))
    return got.select("id", "doi", "title", "year", F.array_join("authors", "; ").alias("author"))


@query("items", f"select scan_order as id, lower(doi) as doi, title, cast({YEAR.format('date')} as int) as year, last_name as author, regexp_replace(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), '^(Abstract|Resumen|ABSTRACT|RESUMEN)[\\s:.\\-‐-―]*', '') as abstract from items where not regexp_matches(abstract, '[<&]')")
def decode_inverted_records(v: Views) -> DataFrame:
    """Records whose abstract is an index from each word to its places."""
    words = F.filter(F.split(F.col("abstract"), r"\s+"), lambda w: w != "")
    index = F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    author = F.array(F.struct(F.struct(F.col("last_name").alias("display_name")).alias("author")))
    record = F.to_json(F.struct(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), "title", T.year_of("date").alias("publication_year"), author.alias("authorships"), index.alias("abstract_inverted_index")))
    got = enrich.decode_b(v.items.where("not abstract rlike '[<&]'").select(F.col("scan_order").alias("id"), record.alias("json")))
    return got.select("id", "doi", "title", "year", F.array_join("authors", "; ").alias("author"), "abstract")


# ---- files that people write, and read back
@query("items", f", {_PLAN} select master, other from plan")
def merge_plan_file(v: Views) -> DataFrame:
    path = shared_path(v.spark, "merge-plan")
    library.write_jsonl(dedupe.merge_plan(_editions(v)).groupBy("master").agg(F.collect_list("other").alias("others")), path)
    return library.read_merge_plan(v.spark, path)


@query("edits", """, e as (select *, row_number() over (order by seq) as n from edits) select n as seq, key, field, value, null as tag, false as remove_tag, false as trash from e union all select n, key, null, null, tag, remove_tag, false from e where tag is not null
  union all select n, key, null, null, null, false, true from e where trash""")
def edits_file(v: Views) -> DataFrame:
    # several files, in whose order the edits are numbered
    some = lambda c: F.when(c, F.array("tag"))
    own = v.edits.repartitionByRange(4, "seq").sortWithinPartitions("seq")
    record = own.select("key", F.create_map("field", "value").alias("set"), some(F.col("tag").isNotNull() & ~F.col("remove_tag")).alias("addTags"), some(F.col("tag").isNotNull() & F.col("remove_tag")).alias("removeTags"), "trash")
    path = shared_path(v.spark, "edits")
    library.write_jsonl(record, path)
    return library.read_edits(v.spark, path).select("seq", "key", "field", "value", "tag", "remove_tag", "trash")


@query("item_tags", "select distinct trim(tag) as tag, upper(trim(tag)) as target from item_tags")
def tag_map_file(v: Views) -> DataFrame:
    path = shared_path(v.spark, "tag-map")
    v.item_tags.select(F.trim("tag").alias("tag")).distinct().select(F.concat(F.lit(" "), "tag", F.lit(" ")).alias("a"), F.upper("tag").alias("b"), F.lit("ignored").alias("c")).write.csv(path)
    return library.read_tag_map(v.spark, path)


@query("items", f"select {_FLAT}, abstract from items")
def export_json_file(v: Views) -> DataFrame:
    path = shared_path(v.spark, "records")
    flat = analyze.flatten_wire(_wire(v))
    library.write_export_json(flat, path)
    read = v.spark.read.schema(flat.schema).json(path).select(*flat.columns)
    return read.withColumns({"creators": F.array_join("creators", "; "), "tags": F.array_join("tags", "; ")})


@query("items", "select key, (row_number() over (order by key) - 1) // 50 as batch from items")
def key_batches(v: Views) -> DataFrame:
    return library.batches(v.items.select("key"), 50).select("batch", F.explode("keys").alias("key"))


@query("items", "select key, title, place, page, total from (select key, title, row_number() over (order by title, key) - 1 as place, cast((row_number() over (order by title, key) - 1) // 25 as int) as page, count(*) over () as total from items) where page between 2 and 4")
def items_list_pages(v: Views) -> DataFrame:
    path = shared_path(v.spark, "pages")
    list_pages.write_pages(v.items.select("key", "title"), ["title", "key"], path, catalog.SEARCH_LIMIT)
    return list_pages.read_pages(v.spark, path, 2, 4).select("key", "title", "place", "page", "total")


# ---- audit log
@query("audit", "select label, count(*) as n, count(*) filter (not ok) as errors, round(sum(code_bytes), 2) as bytes from audit group by label")
def audit_counts(v: Views) -> DataFrame:
    return audit.counts(v.audit)


@query("audit", "select date_trunc('hour', ts) as hour, label, count(*) as n, count(*) filter (not ok) as errors from audit group by 1, 2")
def audit_hourly(v: Views) -> DataFrame:
    return audit.hourly(v.audit)


@query("audit", "select count(*) as n from audit")
def audit_once(v: Views) -> DataFrame:
    return audit.once(v.audit.unionAll(v.audit)).agg(F.count("*").alias("n"))


@query("audit", """, c as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, label, concat(' ', label, ' ', event_id, chr(10), 'second line') as code, ok, case when event_id % 4 = 0 then event_id % 9 end as would_write from audit),
  j as (select event_id, ts, concat('{"ts":"', ts, '","label":"', label, '","codeSHA256":"', substr(sha256(code), 1, 16), '","codeBytes":', length(code), ',"codeHead":"', label, ' ', event_id, '","ok":', ok, case when not ok then concat(',"error":"failed ', event_id, '"') else '' end, case when would_write is not null then concat(',"dryRunWrites":', would_write) else '' end, '}') as value from c)
  select value, begins as "at", cast(begins // 65536 as int) as part from (select value, cast(sum(strlen(value) + 1) over (order by ts, event_id) - strlen(value) - 1 as bigint) as begins from j)""")
def audit_parts(v: Views) -> DataFrame:
    code = F.concat(F.lit(" "), "label", F.lit(" "), F.col("event_id").cast("string"), F.lit("\nsecond line"))
    calls = v.audit.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "label", code.alias("code"), "ok", F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("error"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 9).alias("would_write"))
    return audit.rotated(audit.records(calls, ["event_id"]), ["ts", "event_id"], most=1 << 16).select("part", "at", "value")


@query("audit", """, m as (select concat('A', cast(user_id as varchar)) as key, min(case when event_id % 3 = 0 then 0 else 1 end) as batch, any_value(case when user_id % 2 = 0 then 'attached' else 'nothing to gain' end) as status from audit group by user_id) select key, status, cast(batch as bigint) as batch from m""")
def marked_once(v: Views) -> DataFrame:
    # two batches, the second with the first one's keys among its own; the first is run again as after a stop
    path = shared_path(v.spark, "marks")
    rows = v.audit.select(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("key"), "user_id", "event_id")
    work = lambda todo: todo.select("key", F.when(F.col("user_id") % 2 == 0, "attached").otherwise("nothing to gain").alias("status"))
    for number in (0, 0, 1):
        markers.work_batch(rows.where("event_id % 3 = 0") if number == 0 else rows, number, path, "fetch", work)
    return markers.marks(v.spark, path).select("key", "status", "batch")
