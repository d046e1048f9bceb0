"""Registered queries over modes, default rules, excluded children, objects with their fields, translations and scopes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder
from ..functions.rules import kept
from ..operators import collectors, copies
from ..operators import diff as D
from ..operators import documents as X
from ..sources import sinks
from ..sources import snapshots as S
from .catalogue import query, table
from .tree_catalogue import _PART, collected, part_tree

_MODES = """
f as (select 'o/' || o_orderkey as path, o_orderkey as k, case o_orderkey % 6 when 0 then '160000' when 1 then '120000' when 2 then '100755' when 3 then '040000' else '100644' end as mode from orders),
o as (select * from f where k % 11 <> 0), n as (select * from f where k % 11 = 0 or k % 13 <> 0)
"""


@query(f"""with {_MODES} select coalesce(o.path, n.path) as path, case when o.path is null then 'A' when n.path is null then 'D' else 'M' end as status
from (select * from o where mode like '1%' and mode <> '160000') o full join (select * from n where mode like '1%' and mode <> '160000') n on o.path = n.path
where o.path is null or n.path is null or o.k % 7 = 0""")
def blob_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of two snapshots that hold submodules and directories too, which are no files."""
    k = F.col("o_orderkey")
    mode = F.expr("case o_orderkey % 6 when 0 then '160000' when 1 then '120000' when 2 then '100755' when 3 then '040000' else '100644' end")
    files = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("o/"), k.cast("string")).alias("path"), mode.alias("mode"))
    side = lambda rows, oid: D.blobs_only(rows.select("path", "mode", oid.alias("oid")))
    old = side(files.where("o_orderkey % 11 <> 0"), F.lit("1"))
    new = side(files.where("o_orderkey % 11 = 0 or o_orderkey % 13 <> 0"), F.when(k % 7 == 0, "2").otherwise("1"))
    return D.snapshot_diff(old, new).select("path", "status")


_RULED = """
f as (select p_partkey as k, case p_partkey % 3 when 0 then 'D' when 1 then 'A' else 'M' end as status,
    'src/objects/O' || (p_partkey % 9) || case p_partkey % 4 when 0 then '/recordTypes/' when 1 then '/drafts/' else '/fields/' end || p_partkey || case when p_partkey % 5 = 0 then '.tmp' else '.xml' end as path from part)
"""


@query(f"""with {_RULED} select status, path from f where not (status = 'D' and path like '%/recordTypes/%') and not path like '%.tmp'
    and (not path like '%/drafts/%' or (k % 9 = 1))""")
def default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that the rules of a file keep, and of deletions those that the rule that always holds for them does too."""
    folder = f"{shared_folder(spark)}/driftledger/rules-{uuid.uuid4().hex}"
    sinks.write_text(folder, "rules", "# rules\n*.tmp\n**/drafts/*\n!/src/objects/O1/drafts/*.xml\n")
    k = F.col("p_partkey")
    part = F.when(k % 4 == 0, "/recordTypes/").when(k % 4 == 1, "/drafts/").otherwise("/fields/")
    path = F.concat(F.lit("src/objects/O"), (k % 9).cast("string"), part, k.cast("string"), F.when(k % 5 == 0, ".tmp").otherwise(".xml"))
    status = F.when(k % 3 == 0, "D").when(k % 3 == 1, "A").otherwise("M")
    changes = table(spark, sf_dir, "part").select(status.alias("status"), path.alias("path"))
    return changes.where(kept(F.col("status"), F.col("path"), S.read_rules(spark, f"{folder}/rules")))


_ORDERS_OF = """
c as (select o_custkey as doc, substr(o_orderpriority, 1, 1) as tag, o_orderkey as k from orders),
kinds as (
    select doc, tag, k, case when k % 5 = 0 and doc % 6 <> 0 then 'add' when k % 5 <> 0 and (k % 7 = 0 or doc % 6 = 0) then 'delete' when k % 5 <> 0 and k % 3 = 0 then 'modify' end as kind
    from c where not (k % 5 = 0 and doc % 6 = 0)
)
"""


def customer_documents(spark: SparkSession, sf_dir: str) -> X.DocumentDiff:
    """Customers as documents of their orders, tagged by priority; priorities 3 and 4 are excluded from the members, and every sixth
    customer's document is empty in the new revision."""
    k = F.col("o_orderkey")
    value = lambda q: F.to_json(F.struct(k.cast("string").alias("id"), q.alias("q"))).alias("value")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.substring("o_orderpriority", 1, 1).alias("tag"), k.alias("pos"), k)
    old = rows.where("o_orderkey % 5 <> 0").select("doc", "tag", "pos", value(F.lit("1")))
    new = rows.where("doc % 6 <> 0 and (o_orderkey % 5 = 0 or o_orderkey % 7 <> 0)").select("doc", "tag", "pos", value(F.when(k % 3 == 0, "2").otherwise("1")))
    rules = spark.createDataFrame([(str(t), "id", f"Priority{t}", t in (3, 4)) for t in range(1, 6)], "tag string, key string, xml_name string, excluded boolean")
    return X.document_diff(old, new, rules, keep=True)


@query(f"with {_ORDERS_OF} select doc, kind, 'Priority' || tag as type, cast(k as varchar) as member from kinds where kind is not null and tag not in ('3', '4')")
def excluded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of changed children; excluded tags give none, and a document that is emptied loses all."""
    return customer_documents(spark, sf_dir).changes


@query(f"with {_ORDERS_OF} select doc, coalesce(bool_or(kind in ('add', 'modify')), false) as has_package_content from kinds group by doc")
def documents_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have something to send: additions and modifications of excluded tags count, deletions don't."""
    return customer_documents(spark, sf_dir).documents


@query(f"""with {_PART.format(kinds=2)}, own as (select * from c where status <> 'D'),
file as (select k, kind, case kind when 0 then 'src/objects/O' || (k + 4) || '/fields/X' || k || '.field-meta.xml' else 'src/objects/O' || k || '/O' || k || '.object-meta.xml' end as path from t)
select path, 'file' as kind from own join file using (k)
union select 'src/objects/O' || (k + 4) || '/O' || (k + 4) || '.object-meta.xml', 'file' from own where kind = 0 and k % 2 = 0
union select 'src/objects/O' || own.k || '/fields/X' || f.k || '.field-meta.xml', 'file' from own join t f on f.k = own.k - 4 and f.in_new where own.kind = 1 and f.k % 2 = 0""")
def master_detail_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with fields and objects: the object of a field whose text names a master, and such fields of an object."""
    paths = ("concat('src/objects/O', k + 4, '/fields/X', k, '.field-meta.xml')", "concat('src/objects/O', k, '/O', k, '.object-meta.xml')")
    old, new = part_tree(spark, sf_dir, *paths)
    oids = cut(old.select("oid").unionByName(new.select("oid")).distinct())
    text = F.when(F.substring("oid", 2, 20).cast("long") % 2 == 0, "<CustomField><type>MasterDetail</type></CustomField>").otherwise("<CustomField><type>Text</type></CustomField>")
    blobs = oids.select("oid", text.cast("binary").alias("content"))
    return collected(spark, old, new, blobs).copies.where("kind = 'file'").select("path", "kind").distinct()


@query("""with w as (select p_partkey as k, 'L' || (p_partkey % 11) || '_' || (p_partkey // 700) as doc from part)
select distinct 'package' as target, 'Translations' as type, doc as member, 'modify' as change_kind from w where k % 13 = 0""")
def translations_of_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation files that define a flow of the package, as modified elements."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("F"), k.cast("string"))
    part = table(spark, sf_dir, "part")
    flows = part.select(F.when(k % 13 == 0, "package").otherwise("destructive").alias("target"), F.lit("Flow").alias("type"), name.alias("member"), F.lit("add").alias("change_kind"))
    doc = F.concat(F.lit("src/translations/L"), (k % 11).cast("string"), F.lit("_"), F.floor(k / 700).cast("string"), F.lit(".translation-meta.xml"))
    children = part.select(doc.alias("doc"), F.lit(collectors.FLOW_KEY).alias("tag"), k.alias("pos"), F.to_json(F.struct(name.alias("fullName"))).alias("value"))
    return collectors.flow_translations(flows, children)[0]


@query(f"""with {_MODES}, s(scope) as (values ('x'), ('o'), ('ot/her'))
select scope from s where not exists (select 1 from n) union all select scope from s where scope <> 'o' and exists (select 1 from n)""")
def scopes_without_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three scopes those that a warning names, asked one by one."""
    k = F.col("o_orderkey")
    new = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0 or o_orderkey % 13 <> 0").select(F.concat(F.lit("o/"), k.cast("string")).alias("path"))
    named = [s for scope in ("x", "o", "ot/her") for s in collectors.unmatched_scopes(new, [scope], True)]
    return spark.createDataFrame([(s,) for s in named], "scope string")


@query(f"""with {_PART.format(kinds=2)}, own as (select c.*, case kind when 0 then k + 4 else k end as p, case kind when 0 then k + 4 else k - 4 end as beside from c),
sent as (select distinct p from own where status <> 'D' or exists (select 1 from t where t.k = own.beside and t.in_new))
select 'src/objectTranslations/T' || p || '/T' || p || '.objectTranslation-meta.xml' as path, case when exists (select 1 from c where c.k = p and c.status <> 'D') then 'computed' else 'file' end as kind from sent""")
def object_translation_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the parents of changed translations are sent: pruned to what changed in them, whole where nothing did. A deletion
    that leaves a file of the folder sends what is left."""
    paths = ("concat('src/objectTranslations/T', k + 4, '/F', k, '.fieldTranslation-meta.xml')", "concat('src/objectTranslations/T', k, '/T', k, '.objectTranslation-meta.xml')")
    old, new = part_tree(spark, sf_dir, *paths)
    oids = cut(old.select("oid").unionByName(new.select("oid")).distinct())
    blobs = oids.select("oid", F.concat(F.lit("<CustomObjectTranslation><label>"), "oid", F.lit("</label></CustomObjectTranslation>")).cast("binary").alias("content"))
    found = copies.first_copies(collected(spark, old, new, blobs).copies)
    return found.where(F.col("path").endswith(".objectTranslation-meta.xml")).select("path", "kind")
