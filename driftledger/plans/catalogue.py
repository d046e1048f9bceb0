"""The registered queries over the reference's operators, and the SQL that checks them.

Two snapshots are made of each table by rule: keys drop out on either side, and values change on one. The queries apply the
library's operators to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.rules import ignored, kept, parse_rules
from ..operators import changeset as C
from ..operators import diff as D
from ..operators import documents as X
from ..operators import existence as E
from ..operators import registry as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function as a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- snapshots of orders

_ORDERS = """
o as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 11 <> 0),
n as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 13 <> 0),
d as (
    select coalesce(o.k, n.k) as o_orderkey, o.v as old_price, n.v as new_price,
        case when o.k is null then 'A' when n.k is null then 'D' when o.v is distinct from n.v then 'M' end as status
    from o full join n on o.k = n.k
)
"""


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"))
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return old, orders.where("o_orderkey % 13 <> 0").select("o_orderkey", price.alias("price"))


@query(f"with {_ORDERS} select o_orderkey, status, old_price, new_price, case status when 'A' then 'add' when 'M' then 'modify' else 'delete' end as change_kind from d where status is not null")
def snapshot_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders were added, deleted or changed in price."""
    old, new = order_snapshots(spark, sf_dir)
    return D.snapshot_diff(old, new, ["o_orderkey"], "price").withColumn("change_kind", D.change_kind(F.col("status")))


@query(f"with {_ORDERS} select status, count(*) as n from d where status is not null group by status")
def diff_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = order_snapshots(spark, sf_dir)
    return D.snapshot_diff(old, new, ["o_orderkey"], "price").groupBy("status").agg(F.count("*").alias("n"))


# --- snapshots of pages: a path made of host, language and id, and a digest of the content

_PAGES = """
page as (
    select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || cast(page_id as varchar) as path, md5(html) as oid, html
    from pages where url is not null
),
o as (select path, oid from page where page_id % 5 <> 0),
n as (select path, case when page_id % 4 = 1 then md5(oid) else oid end as oid from page where page_id % 7 <> 0),
d as (
    select coalesce(o.path, n.path) as path, o.oid as old_oid, n.oid as new_oid,
        case when o.path is null then 'A' when n.path is null then 'D' when o.oid is distinct from n.oid then 'M' end as status
    from o full join n on o.path = n.path
)
"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").where("url is not null")
    return pages.select("page_id", F.concat(plain, F.lit("/"), F.col("page_id").cast("string")).alias("path"), F.md5("html").alias("oid"), "html")


def page_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = page_paths(spark, sf_dir)
    oid = F.when(F.col("page_id") % 4 == 1, F.md5("oid")).otherwise(F.col("oid"))
    return pages.where("page_id % 5 <> 0").select("path", "oid"), pages.where("page_id % 7 <> 0").select("path", oid.alias("oid"))


@query(f"with {_PAGES} select path, status, old_oid, new_oid from d where status is not null and (path like 'www.%' or path like '%.com/en/%') and path not like '%.org/%'")
def pathspec_diff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages under two pathspecs, applied to both snapshots before they meet."""
    old, new = page_snapshots(spark, sf_dir)
    wanted = P.matches_pathspec(F.col("path"), ["www.*", "*.com/en/*"]) & ~P.matches_pathspec(F.col("path"), ["*.org/*"])
    return D.snapshot_diff(old.where(wanted), new.where(wanted))


@query(f"""with {_PAGES}, s as (select min(split_part(path, '/', 1)) as a, max(split_part(path, '/', 1)) as b from d where status is not null and path like '%/en/%')
select path, status, old_oid, new_oid from d, s where status is not null and (path = a or starts_with(path, a || '/') or path = b || '/en' or starts_with(path, b || '/en/'))""")
def scoped_diff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages in two scopes, the first host with changed English pages and the English part of the last."""
    old, new = page_snapshots(spark, sf_dir)
    host = F.substring_index("path", "/", 1)
    first, last = D.snapshot_diff(old, new).where("path like '%/en/%'").agg(F.min(host), F.max(host)).first()
    scoped = P.in_scope(F.col("path"), [first, f"{last}/en"])
    return D.snapshot_diff(old.where(scoped), new.where(scoped))


@query(f"""with {_PAGES}, p as (select path, string_split(path, '/') as s from page)
select path, s[-1] as base, array_to_string(s[:-2], '/') as dir, len(s) as depth, s[-2] as parent_folder,
    case when len(s) > 2 then array_to_string(s[3:], '/') else '' end as below_language
from p""")
def path_identity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each page's path."""
    path = F.col("path")
    p = P.parts(path)
    return page_paths(spark, sf_dir).select(
        path, P.base_name(path).alias("base"), P.dir_name(path).alias("dir"), F.size(p).cast("long").alias("depth"),
        F.element_at(p, -2).alias("parent_folder"), P.joined(p, 3, F.size(p) - 2).alias("below_language"),
    )


_RULES = """
# hosts that don't matter
*.example.org
/m.*/en/
!*.example.net
[0-4]*
"""
_DESTRUCTIVE = "fr/\n"
#: Whether the rules ignore p.path: the last rule that matches a directory, outermost first, or the path itself decides.
_IGNORED = """exists (
    select 1 from (select unnest(range(1, len(string_split(p.path, '/')) + 1)) as i) t,
        lateral (select array_to_string(string_split(p.path, '/')[:i], '/') as x, i = len(string_split(p.path, '/')) as leaf) y
    where case
        when regexp_matches(y.x, '^(.*/)?[0-4][^/]*$') then true
        when regexp_matches(lower(y.x), '^(.*/)?[^/]*\\.example\\.net$') then false
        when not y.leaf and regexp_matches(lower(y.x), '^m\\.[^/]*/en$') then true
        when regexp_matches(lower(y.x), '^(.*/)?[^/]*\\.example\\.org$') then true
        else false end
)"""


@query(f"""with {_PAGES}, p as (select path, status from d where status is not null)
select path, status from p where case when status = 'D' then not (path like '%/fr/%' or path like '%/recordTypes/%') else not {_IGNORED} end""")
def ignore_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages that the ignore rules keep: deletions by the destructive ones."""
    changes = D.snapshot_diff(*page_snapshots(spark, sf_dir)).select("path", "status")
    return changes.where(kept(F.col("status"), F.col("path"), parse_rules(_RULES), parse_rules(_DESTRUCTIVE)))


@query(f"""with {_PAGES}, p as (select distinct path from n)
select path, s.status from p, (values ('A'), ('D')) s(status) where case when s.status = 'D' then path like '%/fr/%' else {_IGNORED} end""")
def include_rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the new snapshot that include rules bring back, as additions and as deletions."""
    from ..operators.collectors import included

    _, new = page_snapshots(spark, sf_dir)
    return included(new, parse_rules(_RULES), parse_rules(_DESTRUCTIVE)).select("path", "status")


def _page_registry(spark: SparkSession) -> R.Registry:
    """Types by a page's place: languages are directories, one of them owns what is in it, one host is a suffix."""
    return R.Registry.of(spark, [
        R.TypeDef("English", directory_name="en"),
        R.TypeDef("French", directory_name="fr", in_folder=True),
        R.TypeDef("German", directory_name="de"),
        R.TypeDef("Seven", directory_name="7"),
        R.TypeDef("Eleven", suffix="11", directory_name="11"),
    ])


@query(f"""with {_PAGES}, changed as (select path, status from d where status is not null), hits as (
    select path, pos, case seg when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when '7' then 'Seven' when '11' then 'Eleven' end as t
    from (select path, unnest(string_split(path, '/')) as seg, generate_subscripts(string_split(path, '/'), 1) as pos from (select distinct path from changed))
    where seg in ('en', 'fr', 'de', '7', '11')
), stop as (select path, min(pos) as stop from hits where t = 'French' group by path),
last as (select h.path, max_by(t, pos) as t from hits h left join stop s on h.path = s.path where s.stop is null or pos <= s.stop group by h.path)
select c.path, c.status, l.t as type from changed c left join last l on c.path = l.path""")
def type_lookup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each changed page, by suffix, directory or name."""
    changes = D.snapshot_diff(*page_snapshots(spark, sf_dir)).select("path", "status")
    return R.lookup(changes, _page_registry(spark))


@query(f"""with {_PAGES}, named as (select path, status, lower(string_split(path, '/')[-2]) as name from d where status is not null)
select path, status, name from named x where status <> 'D' or not exists (select 1 from named a where a.status = 'A' and a.name = x.name)""")
def cancel_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages without the deletions of which an addition has the directory's name."""
    changes = D.snapshot_diff(*page_snapshots(spark, sf_dir)).select("path", "status")
    return D.cancel_deletions(changes.withColumn("name", F.lower(F.element_at(P.parts(F.col("path")), -2))), "name")


# --- documents

_RENAMES = """
o as (select 'old/' || cast(doc_id as varchar) as path, md5(text) as oid from documents where doc_id % 3 <> 0),
n as (select case when doc_id % 2 = 0 then 'new/' else 'old/' end || cast(doc_id as varchar) as path, md5(text) as oid from documents where doc_id % 5 <> 0),
gone as (select oid, path, row_number() over (partition by oid order by path) as r from o where oid is not null and path not in (select path from n)),
come as (select oid, path, row_number() over (partition by oid order by path) as r from n where oid is not null and path not in (select path from o)),
pairs as (select gone.path as from_path, come.path as to_path from gone join come using (oid, r))
"""


def moved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name, oid = F.col("doc_id").cast("string"), F.md5("text").alias("oid")
    old = docs.where("doc_id % 3 <> 0").select(F.concat(F.lit("old/"), name).alias("path"), oid)
    new = docs.where("doc_id % 5 <> 0").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "new/").otherwise("old/"), name).alias("path"), oid)
    return D.snapshot_diff(old, new)


@query(f"with {_RENAMES} select from_path, to_path, cast(100 as integer) as similarity from pairs")
def exact_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that moved without a change, copies paired in order."""
    return D.exact_renames(moved_documents(spark, sf_dir))


@query(f"with {_RENAMES} select 'D' as status, from_path as path from pairs union all select 'A', to_path from pairs")
def expanded_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each move as a deletion and an addition."""
    pairs = D.exact_renames(moved_documents(spark, sf_dir))
    return D.expand_renames(pairs.select(F.lit("R").alias("status"), F.col("to_path").alias("path"), F.col("from_path").alias("old_path")))


@query(f"""with {_RENAMES} select 'Document' as type, string_split(from_path, '/')[-1] as from_member, string_split(to_path, '/')[-1] as to_member
from pairs where string_split(from_path, '/')[-1] <> string_split(to_path, '/')[-1] group by all""")
def rename_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves by type and member: those that keep their member rename nothing."""
    pairs = D.exact_renames(moved_documents(spark, sf_dir))
    side = lambda s, c: pairs.select(F.lit(s).alias("side"), F.col(c).alias("path"), F.lit("Document").alias("type"), P.base_name(F.col(c)).alias("member"))
    return C.resolve_renames(pairs, side("from", "from_path").unionByName(side("to", "to_path")))


_SIMILAR = """
p as (
    select p_partkey as k, case when p_partkey % 10 = 5 then 'g' || (p_partkey // 50) else 'f' || p_partkey end as lines,
        case when p_partkey % 10 = 5 then 2 else 1 + 2 * (p_partkey % 4) end as changed
    from part
),
d as (select lines, changed, 'd/' || k as path, row_number() over (partition by lines order by 'd/' || k) as n from p),
a as (select lines, changed, 'a/' || (9000000 - k) as path, row_number() over (partition by lines order by 'a/' || (9000000 - k)) as n from p)
"""


@query(f"with {_SIMILAR} select d.path as from_path, a.path as to_path, cast(100 * (12 - d.changed) // 12 as integer) as similarity from d join a using (lines, n) where 100 * (12 - d.changed) // 12 >= 50")
def similar_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of twelve lines, moved and edited in some; five in fifty have the same lines on either side."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 10 == 5, F.concat(F.lit("g"), F.floor(k / 50).cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("own"), F.when(k % 10 == 5, 2).otherwise(1 + 2 * (k % 4)).alias("changed"))
    content = lambda mark: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat("own", F.lit(" line "), i.cast("string"), F.when(i <= F.col("changed"), F.lit(mark)).otherwise(F.lit("")))), "\n")
    old = parts.select(F.concat(F.lit("d/"), F.col("k").cast("string")).alias("path"), content("").alias("content"))
    new = parts.select(F.concat(F.lit("a/"), (9_000_000 - F.col("k")).cast("string")).alias("path"), content(" edited").alias("content"))
    return D.similar_renames(D.snapshot_diff(old, new, ["path"], "content").select("path", "status"), old, new)


@query("select doc_id, source from documents where contains(text, 'password') or contains(text, 'License')")
def content_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of two strings."""
    docs = table(spark, sf_dir, "documents")
    return E.grep(docs, F.col("text"), ["password", "License"]).select("doc_id", "source")


_SPACED = """
pair as (
    select doc_id, text as a, case doc_id % 4 when 0 then text || ' x' when 1 then replace(text, ' ', chr(10)) else replace(replace(text, chr(10), ' ' || chr(10) || chr(9) || chr(10)), ' ', '  ') end as b
    from documents where doc_id is not null and text <> ''
),
lines as (select doc_id, a, b, list_transform([a, b], lambda t: list_filter(list_transform(string_split(t, chr(10)), lambda l: translate(l, chr(9) || chr(11) || chr(12) || chr(13) || ' ', '')), lambda l: l <> '')) as x from pair)
"""


@query(f"with {_SPACED} select doc_id, 'M' as status from lines where a <> b and x[1] <> x[2]")
def whitespace_only_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents: half get spaces and blank lines only, and go; a quarter a word more, a quarter other line breaks, and stay."""
    old, new = spaced_documents(spark, sf_dir)
    changes = D.snapshot_diff(old, new, ["path"], "content").select("path", "status")
    return D.drop_whitespace_changes(changes, old, new).select(F.col("path").alias("doc_id"), "status")


def spaced_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents with an id before and after; null and empty texts stay as they are."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    old = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    spaced = F.replace(F.replace("text", F.lit("\n"), F.lit(" \n\t\n")), F.lit(" "), F.lit("  "))
    k = F.col("doc_id") % 4
    changed = F.when(F.length("text") == 0, F.col("text")).when(k == 0, F.concat("text", F.lit(" x"))).when(k == 1, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(spaced)
    return old, docs.select(F.col("doc_id").alias("path"), changed.alias("content"))


# --- documents of keyed children: orders and their lines

_LINES = """
line as (select l_orderkey as doc, l_returnflag || '-' || cast(l_linenumber as varchar) as member, l_partkey, l_suppkey, cast(l_quantity as bigint) as q from lineitem),
o as (select doc, member, max(l_partkey * 1000000 + l_suppkey * 100 + q) as pos, max_by(q, l_partkey * 1000000 + l_suppkey * 100 + q) as q from line where l_suppkey % 5 <> 0 group by all),
n as (select *, row_number() over (partition by doc, member order by pos) as r from (
    select doc, member, l_partkey * 1000000 + l_suppkey * 100 + q as pos, case when l_partkey % 6 = 0 then q + 1 else q end as q from line where l_suppkey % 7 <> 0)),
b as (
    select coalesce(n.doc, o.doc) as doc, coalesce(n.member, o.member) as member, n.q as nq, o.q as oq, case when o.doc is null then 'add' when n.doc is null then 'delete' when n.q <> o.q then 'modify' end as kind
    from (select doc, member, 1 as r, q from o) o full join n on n.doc = o.doc and n.member = o.member and n.r = o.r
)
"""


def order_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two revisions of orders as documents of lines, keyed by flag and number, and their tag rule."""
    q = F.col("l_quantity").cast("long")
    pos = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + q
    member = F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("line").alias("tag"), pos.alias("pos"), "l_partkey", "l_suppkey", member.alias("id"), q.alias("q"))
    value = lambda q: F.to_json(F.struct("id", q.cast("string").alias("q"))).alias("value")
    old = lines.where("l_suppkey % 5 <> 0").select("doc", "tag", "pos", value(F.col("q")))
    new = lines.where("l_suppkey % 7 <> 0").select("doc", "tag", "pos", value(F.when(F.col("l_partkey") % 6 == 0, F.col("q") + 1).otherwise(F.col("q"))))
    return old, new, spark.createDataFrame([("line", "id", "OrderLine", False)], "tag string, key string, xml_name string, excluded boolean")


@query(f"with {_LINES} select doc, kind, 'OrderLine' as type, member, count(*) as n from b where kind is not null group by all")
def keyed_children_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines added, modified or deleted inside their orders."""
    changes = X.document_diff(*order_documents(spark, sf_dir)).changes
    return changes.groupBy("doc", "kind", "type", "member").agg(F.count("*").alias("n"))


@query(f"""with {_LINES} select doc, bool_or(kind in ('add', 'modify')) as has_package_content
from (select doc, coalesce(kind, '') as kind from b union all select doc, '' from o union all select doc, '' from n) group by doc""")
def surviving_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders have something left to send."""
    return X.document_diff(*order_documents(spark, sf_dir)).documents


@query(f"""with {_LINES}, kept as (
    select n.doc, n.pos from n left join (select doc, member, 1 as r, q from o) o on n.doc = o.doc and n.member = o.member and n.r = o.r where o.doc is null or n.q <> o.q
) select doc, count(*) as n_children, min(pos) as first_pos, max(pos) as last_pos from kept group by doc""")
def retained_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each order to send."""
    left = X.document_diff(*order_documents(spark, sf_dir), keep=True).retained
    return left.groupBy("doc").agg(F.count("*").alias("n_children"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("""with turn as (select conv_id, turn, text from conversations where conv_id is not null),
o as (select conv_id, list(coalesce(text, '<null>') order by turn, text) as l from turn where not (conv_id % 3 = 0 and turn = 1) group by conv_id),
n as (select conv_id, list(coalesce(text, '<null>') order by turn, text) as l from turn group by conv_id)
select n.conv_id as doc, o.l is distinct from n.l as has_package_content from n left join o on n.conv_id = o.conv_id""")
def ordered_array_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations changed as an ordered list of turns."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    turns = turns.select(F.col("conv_id").alias("doc"), F.lit("turn").alias("tag"), "turn", F.coalesce("text", F.lit("<null>")).alias("text"))
    rows = lambda df: df.select("doc", "tag", F.struct("turn", "text").alias("pos"), F.to_json(F.struct("text")).alias("value"))
    rules = spark.createDataFrame([("turn", X.ARRAY_KEY, "Turn", False)], "tag string, key string, xml_name string, excluded boolean")
    return X.document_diff(rows(turns.where("not (doc % 3 = 0 and turn = 1)")), rows(turns), rules).documents


@query("""with n as (select user_id as doc, props from events where event_id % 3 <> 0 and props is not null),
o as (select distinct user_id as doc, props from events where event_id % 3 = 0 and props is not null)
select n.doc, n.props as value, count(*) as n from n where not exists (select 1 from o where o.doc = n.doc and o.props = n.props) group by all""")
def object_fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties of a user that the user's earlier events don't have, by their exact text."""
    events = table(spark, sf_dir, "events").where("props is not null").select(F.col("user_id").alias("doc"), F.lit("props").alias("tag"), F.col("event_id").alias("pos"), F.col("props").alias("value"))
    rules = spark.createDataFrame([("props", X.OBJECT_KEY, "Props", True)], "tag string, key string, xml_name string, excluded boolean")
    left = X.document_diff(events.where("pos % 3 = 0"), events.where("pos % 3 <> 0"), rules).retained
    return left.groupBy("doc", "value").agg(F.count("*").alias("n"))


@query("select event_id, true as equal from events where props is not null")
def deep_equal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties equal themselves with their keys turned round."""
    events = table(spark, sf_dir, "events").where("props is not null")
    pairs = F.from_json("props", "map<string,string>")
    turned = F.to_json(F.map_from_entries(F.reverse(F.map_entries(pairs))))
    plain = F.to_json(F.map_from_entries(F.map_entries(pairs)))
    return events.select("event_id", X.canonical(turned).eqNullSafe(X.canonical(plain)).alias("equal"))


# --- existence

@query("""with gone as (select l_orderkey, l_linenumber from lineitem where l_suppkey % 3 = 0),
rest as (select distinct l_orderkey from lineitem where l_suppkey % 3 <> 0)
select cast(g.l_orderkey as varchar) as member, case when r.l_orderkey is null then 'destructive' else 'package' end as target, 'delete' as change_kind, count(*) as n
from gone g left join rest r on g.l_orderkey = r.l_orderkey group by all""")
def bundle_existence_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which lines were deleted: sent again where lines are left, else removed."""
    lines = table(spark, sf_dir, "lineitem")
    gone = lines.where("l_suppkey % 3 = 0").select(F.col("l_orderkey").cast("string").alias("member"))
    rest = lines.where("l_suppkey % 3 <> 0").select(F.col("l_orderkey").cast("string").alias("member"))
    return E.deletion_target(gone, rest, ["member"]).withColumn("change_kind", F.lit("delete")).groupBy("member", "target", "change_kind").agg(F.count("*").alias("n"))


@query(f"""with {_PAGES}, dirs as (
    select distinct array_to_string(string_split(path, '/')[:i], '/') as dir from (select path, unnest(range(1, len(string_split(path, '/')))) as i from n)
) select d.path, array_to_string(string_split(d.path, '/')[:-2], '/') in (select dir from dirs) as directory_exists from d where status = 'D'""")
def directory_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted pages, and whether anything is left in their directory."""
    old, new = page_snapshots(spark, sf_dir)
    gone = D.snapshot_diff(old, new).where("status = 'D'").select("path", P.dir_name(F.col("path")).alias("dir"))
    return E.with_existence(gone, new, "dir", "directory_exists").select("path", "directory_exists")


@query(f"""with {_PAGES}, names as (select distinct string_split(path, '/')[1] as host, string_split(path, '/')[-2] as name from page where page_id % 3 = 0),
s as (select path, string_split(path, '/')[1] as host, string_split(path, '/') as p from page),
hit as (select s.path, max(i) as i from (select path, host, p, unnest(range(2, len(p))) as i from s) s join names x on x.host = s.host and x.name = s.p[s.i] group by s.path)
select s.path, coalesce(s.p[h.i], s.p[-1]) as component from s left join hit h on h.path = s.path""")
def boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost directory of each page that is a known name under its host, else the file."""
    pages = page_paths(spark, sf_dir)
    host = F.substring_index("path", "/", 1)
    names = pages.where("page_id % 3 = 0").select(host.alias("type_dir"), F.element_at(P.parts(F.col("path")), -2).alias("name")).distinct()
    return E.innermost_component(pages.select("path", host.alias("type_dir")), names).select("path", "component")


# --- views

_ELEMENTS = """
e as (
    select case when p_size % 3 = 0 then 'destructive' else 'package' end as target, p_brand as type, p_type || '.' || cast(p_partkey % 17 as varchar) as member,
        case p_partkey % 3 when 0 then 'add' when 1 then 'modify' else 'delete' end as change_kind
    from part
),
r as (
    select distinct a.p_brand as type, a.p_type || '.' || cast(a.p_partkey % 17 as varchar) as f, b.p_type || '.' || cast(b.p_partkey % 17 as varchar) as t
    from part a join part b on b.p_partkey = a.p_partkey + 1 and a.p_brand = b.p_brand
),
package as (select type, member from e where target = 'package' union select type, t from r)
"""


def part_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").withColumn("p_type", F.concat_ws(".", "p_type", (F.col("p_partkey") % 17).cast("string")))
    kind = F.when(F.col("p_partkey") % 3 == 0, "add").when(F.col("p_partkey") % 3 == 1, "modify").otherwise("delete")
    elements = part.select(F.when(F.col("p_size") % 3 == 0, C.DESTRUCTIVE).otherwise(C.PACKAGE).alias("target"), F.col("p_brand").alias("type"), F.col("p_type").alias("member"), kind.alias("change_kind"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), "p_brand", F.col("p_type").alias("to_member"))
    return elements, part.join(following, ["p_partkey", "p_brand"]).select(F.col("p_brand").alias("type"), F.col("p_type").alias("from_member"), "to_member")


@query(f"with {_ELEMENTS} select type, member from package")
def package_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.package_view(*part_elements(spark, sf_dir))


@query(f"with {_ELEMENTS} (select type, member from e where target = 'destructive' union select type, f from r) except select type, member from package")
def destructive_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.destructive_view(*part_elements(spark, sf_dir))


@query(f"""with {_ELEMENTS},
a as (select type, member from e where change_kind = 'add' except select type, t from r),
m as (select distinct type, member from e where change_kind = 'modify'),
x as (select type, member from e where change_kind = 'delete' except (select type, member from e where change_kind in ('add', 'modify') union select type, f from r))
select 'add' as kind, type, member, cast(null as varchar) as to_member from a union all select 'modify', type, member, null from m
union all select 'delete', type, member, null from x union all select 'rename', type, f, t from r""")
def kind_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kind_view(*part_elements(spark, sf_dir))


@query(f"with {_ELEMENTS} select target, type, count(distinct member) as n_members, md5(string_agg(distinct member, ',' order by member)) as digest from e group by target, type")
def members_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = C.by_target(part_elements(spark, sf_dir)[0])
    return grouped.select("target", "type", F.size("members").cast("long").alias("n_members"), F.md5(F.array_join("members", ",")).alias("digest"))


@query(f"with {_ELEMENTS} select change_kind, type, count(distinct member) as n_members, md5(string_agg(distinct member, ',' order by member)) as digest from e group by change_kind, type")
def members_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = C.by_kind(part_elements(spark, sf_dir)[0])
    return grouped.select("change_kind", "type", F.size("members").cast("long").alias("n_members"), F.md5(F.array_join("members", ",")).alias("digest"))


@query(f"""with {_ELEMENTS}, k as (select type, member, min(case change_kind when 'add' then 1 when 'modify' then 2 else 3 end) as k from e group by type, member)
select distinct target, e.type, e.member, case k when 1 then 'add' when 2 then 'modify' else 'delete' end as change_kind from e join k on e.type = k.type and e.member = k.member""")
def reconstructed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reconstructed(part_elements(spark, sf_dir)[0])


@query(f"with {_ELEMENTS}, g as (select type, string_agg(member, ',' order by member) as members from package group by type) select row_number() over (order by type <> 'Brand#3', type) as place, type, members from g")
def manifest_grouped_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package as manifest blocks, one type first."""
    blocks = C.manifest(C.package_view(*part_elements(spark, sf_dir)), first="Brand#3", collation="utf8_binary")
    return blocks.select(F.col("place").cast("long").alias("place"), "type", F.array_join("members", ",").alias("members"))


@query("""with e as (
    select case when n_nationkey % 2 = 0 then 'package' else 'destructive' end as target, 'Region' as type, r_name || '/' || n_name as member from nation join region on n_regionkey = r_regionkey where n_nationkey % 5 < 2
    union all select case when c_custkey % 2 = 0 then 'package' else 'destructive' end, 'Customer', r_name || '/' || n_name || '.' || cast(c_custkey as varchar) from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
) select * from e where type <> 'Customer' or not exists (select 1 from e p where p.type = 'Region' and p.target = e.target and p.member = split_part(e.member, '.', 1))""")
def rollup_covered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations that aren't listed themselves."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("name"))
    target = lambda key: F.when(F.col(key) % 2 == 0, C.PACKAGE).otherwise(C.DESTRUCTIVE).alias("target")
    parents = nation.where("n_nationkey % 5 < 2").select(target("n_nationkey"), F.lit("Region").alias("type"), F.col("name").alias("member"))
    children = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    children = children.select(target("c_custkey"), F.lit("Customer").alias("type"), F.concat_ws(".", "name", F.col("c_custkey").cast("string")).alias("member"))
    return C.roll_up(parents.unionByName(children), parent="Region", child="Customer")


@query("""with packaged as (select distinct lower(split_part(text, ' ', 1)) as name from benchmark where text is not null)
select distinct d.doc_id from documents d, unnest(list_distinct(string_split(lower(d.text), ' '))) as t(w) where w in (select name from packaged)""")
def flow_backreference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that refer to a packaged name: the first words of the benchmark items."""
    packaged = table(spark, sf_dir, "benchmark").where("text is not null").select(F.lower(F.substring_index("text", " ", 1)).alias("name"))
    named = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("name"))
    return E.referring(named, packaged, "name").select("doc_id").distinct()


@query("""with o as (select o_custkey as doc, o_orderkey as item from orders where o_orderkey % 3 = 0), n as (select o_custkey as doc, o_orderkey as item from orders where o_orderkey % 2 = 0)
select doc, item, true as existing from o union all select doc, item, false from n where not exists (select 1 from o where o.doc = n.doc and o.item = n.item)""")
def merge_existing_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders already in a customer's output, then the new ones that aren't."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"))
    return E.merged(orders.where("item % 3 = 0"), orders.where("item % 2 = 0"), ["doc", "item"])


@query("""with t as (select suffix, count(distinct n_name) as n from (select lower(substr(n_name, length(n_name) - 1, 2)) as suffix, n_name from nation) group by suffix)
select suffix from t where n > 1 union select unnest(['app', 'xml', 'md'])""")
def unsafe_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings that two nations share, and the fixed ones."""
    return R.unsafe_suffixes(table(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", F.length("n_name") - 1, F.lit(2))).alias("suffix"), F.col("n_name").alias("type")))


@query(f"with {_PAGES} select path, min(page_id) as seq, count(*) as n from (select path, page_id from page union all select path, page_id + 1000000 from page where page_id % 2 = 0) group by path")
def copy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several copies to one path the first is made."""
    from ..operators.copies import first_copies

    pages = page_paths(spark, sf_dir)
    asked = pages.select("path", F.col("page_id").alias("seq")).unionByName(pages.where("page_id % 2 = 0").select("path", (F.col("page_id") + 1_000_000).alias("seq")))
    n = asked.groupBy("path").agg(F.count("*").alias("n"))
    return first_copies(asked.withColumn("kind", F.lit("file"))).select("path", "seq").join(n, "path")


@query()
def html_root_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct children of each article of each page, by the lenient reader."""
    from ..functions.xmltree import children_of

    pages = table(spark, sf_dir, "pages").where("html is not null")
    articles = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<article\b[^>]*>.*?</article>"), F.lit(0))).alias("article", "content"))
    rows = children_of(articles.select(F.concat_ws(":", "page_id", "article").alias("doc"), "content"), lenient=True)
    place = lambda k: F.element_at(F.split("doc", ":"), k).cast("long")
    return rows.select(place(1).alias("page_id"), place(2).alias("article"), "tag", "pos", "value")



from . import rule_catalogue, tree_catalogue  # noqa: E402, F401 - they register their queries here
