"""Registered queries over file trees and documents made of part, customer and nation, and the SQL that checks them.

Each row of part is a file: its place tells its type, rules on its key tell in which of two snapshots it is and whether it
changed. Customers are the children of one document for each forty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.lineage import shared_folder
from ..functions.rules import parse_rules
from ..functions.xmltree import children_of
from ..functions.xmltree import whole_documents as xml_whole
from ..operators import changeset as C
from ..operators import collectors, copies, handlers
from ..operators import diff as D
from ..operators import documents as X
from ..operators import existence as E
from ..operators import registry as R
from ..operators import trees as T
from ..sources import sinks
from ..sources import snapshots as S
from ..sources.filetree import read_tree
from .catalogue import page_paths, page_snapshots, part_elements, query, table
from .catalogue import _ELEMENTS, _PAGES
from .engine import Options, delta

TYPES = [
    R.TypeDef("ApexClass", directory_name="classes", suffix="cls", meta_file=True),
    R.TypeDef("Flow", directory_name="flows", suffix="flow"),
    R.TypeDef("CustomObject", directory_name="objects", suffix="object", decomposition="folderPerType"),
    R.TypeDef("CustomField", directory_name="fields", suffix="field", parent_xml_name="CustomObject", xml_tag="fields", key="fullName"),
    R.TypeDef("Index", directory_name="indexes", suffix="index", parent_xml_name="CustomObject"),
    R.TypeDef("RecordType", directory_name="recordTypes", suffix="recordType", parent_xml_name="CustomObject", xml_tag="recordTypes", key="fullName"),
    R.TypeDef("LightningComponentBundle", directory_name="lwc", adapter="bundle", meta_file=True),
    R.TypeDef("StaticResource", directory_name="staticresources", suffix="resource", adapter="mixedContent", meta_file=True),
    R.TypeDef("DigitalExperienceBundle", directory_name="digitalExperiences", suffix="digitalExperience", adapter="digitalExperience"),
    R.TypeDef("Report", directory_name="reports", suffix="report", in_folder=True, content=(("report", "Report"), ("reportFolder", "ReportFolder"))),
    R.TypeDef("Document", directory_name="documents", suffix="document", in_folder=True, meta_file=True),
    R.TypeDef("PermissionSet", directory_name="permissionsets", suffix="permissionset"),
    R.TypeDef("VirtualBot", directory_name="bots", meta_file=True, content=(("bot", "Bot"), ("botVersion", "BotVersion"))),
    R.TypeDef("CustomObjectTranslation", directory_name="objectTranslations", suffix="objectTranslation"),
    R.TypeDef("Workflow", directory_name="workflows", suffix="workflow"),
    R.TypeDef("WorkflowAlert", parent_xml_name="Workflow", xml_tag="alerts", key="fullName"),
    R.TypeDef("CustomLabels"),
    R.TypeDef("CustomLabel", directory_name="labels", suffix="labels", parent_xml_name="CustomLabels", xml_tag="labels", key="fullName"),
]

# --- a tree of one file for each part

_PART = """
t as (
    select p_partkey as k, (p_partkey // 4) % {kinds} as kind, p_partkey % 7 <> 0 as in_new,
        case when p_partkey % 5 = 0 and p_partkey % 7 <> 0 then 'A' when p_partkey % 7 = 0 and p_partkey % 5 <> 0 then 'D'
            when p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 3 = 0 then 'M' end as status
    from part
),
c as (select *, case status when 'A' then 'add' when 'M' then 'modify' else 'delete' end as change_kind from t where status is not null)
"""


def part_tree(spark: SparkSession, sf_dir: str, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of part: a part's path is one of paths, SQL expressions over its key k."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    kind = F.expr(f"(k div 4) % {len(paths)}")
    path = F.expr("case " + " ".join(f"when (k div 4) % {len(paths)} = {i} then {p}" for i, p in enumerate(paths)) + " end")
    rows = k.select("k", kind.alias("kind"), path.alias("path"), F.lit("100644").alias("mode"))
    oid = lambda changed: F.concat(F.when(changed, "n").otherwise("o"), F.col("k").cast("string")).alias("oid")
    return rows.where("k % 5 <> 0").select("path", oid(F.lit(False)), "mode"), rows.where("k % 7 <> 0").select("path", oid(F.expr("k % 3 = 0")), "mode")


def collected(spark: SparkSession, old: DataFrame, new: DataFrame, blobs: DataFrame | None = None) -> handlers.Outcome:
    registry = R.Registry.of(spark, TYPES)
    changes = R.lookup(D.snapshot_diff(old, new).select("status", "path"), registry).where("type is not null")
    return handlers.collect(changes, registry, old, new, blobs)


FILES = (
    "concat('src/classes/C', k, '.cls')", "concat('src/classes/C', k, '.cls-meta.xml')", "concat('src/flows/F', k, '.flow-meta.xml')",
    "concat('src/documents/f', k % 3, '/d', k, 'x.document')", "concat('src/reports/f', k % 3, '/r', k, 'x.report-meta.xml')",
    "concat('src/reports/g', k, '.reportFolder-meta.xml')", "concat('src/objects/O', k, '/O', k, '.object-meta.xml')",
    "concat('src/objects/P', k, '/fields/X', k, '.field-meta.xml')", "concat('src/objects/Q', k, '/indexes/I', k, '.index-meta.xml')",
    "concat('src/permissionsets/S', k, '.permissionset-meta.xml')", "concat('src/notes/N', k, '.txt')",
)


@query(f"""with {_PART.format(kinds=11)}
select case status when 'D' then 'destructive' else 'package' end as target,
    case kind when 0 then 'ApexClass' when 1 then 'ApexClass' when 2 then 'Flow' when 3 then 'Document' when 4 then 'Report' when 5 then 'ReportFolder'
        when 6 then 'CustomObject' when 7 then 'CustomField' when 8 then 'Index' else 'PermissionSet' end as type,
    case kind when 0 then 'C' || k when 1 then 'C' || k when 2 then 'F' || k when 3 then 'f' || (k % 3) || '/d' || k || 'x' when 4 then 'f' || (k % 3) || '/r' || k || 'x'
        when 5 then 'g' || k when 6 then 'O' || k when 7 then 'P' || k || '.X' || k when 8 then 'Q' || k || '.I' || k else 'S' || k end as member,
    change_kind from c where kind < 10""")
def handler_elements_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of changed files: plain ones, companions, files and folders in folders, objects, their fields and indexes."""
    return collected(spark, *part_tree(spark, sf_dir, *FILES)).elements


@query(f"""with {_PART.format(kinds=11)}, own as (select * from c where status <> 'D')
select 'src/classes/C' || k || '.cls' || m as path, 'file' as kind from own, (values (''), ('-meta.xml')) x(m) where kind < 2
union all select 'src/flows/F' || k || '.flow-meta.xml', 'file' from own where kind = 2
union all select 'src/documents/f' || (k % 3) || '/d' || k || 'x.document' || m, 'file' from own, (values (''), ('-meta.xml')) x(m) where kind = 3
union all select distinct 'src/documents/f' || (k % 3) || '.document-meta.xml', 'file' from own where kind = 3
union all select 'src/reports/f' || (k % 3) || '/r' || k || 'x.report-meta.xml', 'file' from own where kind = 4
union all select distinct 'src/reports/f' || (k % 3) || '-meta.xml', 'file' from own where kind = 4
union all select 'src/reports/g' || k || '.reportFolder-meta.xml' || m, 'file' from own, (values (''), ('-meta.xml')) x(m) where kind = 5
union all select 'src/objects/O' || k || '/O' || k || '.object-meta.xml', 'file' from own where kind = 6
union all select 'src/objects/P' || k || '/fields/X' || k || '.field-meta.xml', 'file' from own where kind = 7
union all select 'src/objects/Q' || k || '/indexes/I' || k || '.index-meta.xml', 'file' from own where kind = 8
union all select 'src/permissionsets/S' || k || '.permissionset-meta.xml', 'file' from own where kind = 9""")
def handler_copies_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is copied for changed files: each file, its companion and its folder's file."""
    return collected(spark, *part_tree(spark, sf_dir, *FILES)).copies.select("path", "kind").distinct()


BUNDLES = (
    "concat('src/lwc/b', k % 40, '/f', k, '.js')", "concat('src/staticresources/r', k % 40, '/f', k, '.png')",
    "concat('src/digitalExperiences/site/s', k % 20, '/view/v', k % 60, '/f', k, '.json')",
)


@query(f"""with {_PART.format(kinds=3)}, n as (select *, case kind when 2 then 's' || (k % 20) || '.view/v' || (k % 60) when 0 then 'b' || (k % 40) else 'r' || (k % 40) end as name from t)
select distinct case when c.status <> 'D' or exists (select 1 from n where n.kind = c.kind and n.in_new and n.name = own.name) then 'package' else 'destructive' end as target,
    case c.kind when 0 then 'LightningComponentBundle' when 1 then 'StaticResource' else 'DigitalExperience' end as type,
    case c.kind when 2 then 'site/' else '' end || own.name as member, c.change_kind
from c join n own on own.k = c.k""")
def handler_elements_of_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of files in bundles: a bundle of which files are left is sent again."""
    return collected(spark, *part_tree(spark, sf_dir, *BUNDLES)).elements


@query(f"""with {_PART.format(kinds=3)}, sent as (select distinct kind, k % 40 as b from c where kind < 2 and (status <> 'D' or exists (select 1 from t x where x.kind = c.kind and x.k % 40 = c.k % 40 and x.in_new)))
select case t.kind when 0 then 'src/lwc/b' || b || '/f' || k || '.js' else 'src/staticresources/r' || b || '/f' || k || '.png' end as path
from sent join t on t.kind = sent.kind and t.k % 40 = b and (in_new or status <> 'D')
union select 'src/staticresources/r' || b || '.resource-meta.xml' from sent where kind = 1
union select case kind when 0 then 'src/lwc/b' || (k % 40) || '/f' || k || '.js' else 'src/staticresources/r' || (k % 40) || '/f' || k || '.png' end from c
    where kind < 2 and exists (select 1 from sent where sent.kind = c.kind and b = c.k % 40)""")
def handler_copies_of_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is copied for changed bundles: all that is in them."""
    old, new = (s.where("path not like '%digitalExperiences%'") for s in part_tree(spark, sf_dir, *BUNDLES))
    return collected(spark, old, new).copies.select("path").distinct()


@query(f"""with {_PART.format(kinds=2)}, b as (select * from c where kind = 0), s as (select * from c where kind = 1)
select case status when 'D' then 'destructive' else 'package' end as target, 'BotVersion' as type, 'B' || (k % 30) || '.v' || k as member, change_kind from b
union select 'package', 'Bot', 'B' || (k % 30), change_kind from b where status <> 'D'
union select case when status <> 'D' or exists (select 1 from t x where x.kind = 1 and x.k % 40 = s.k % 40 and x.in_new) then 'package' else 'destructive' end, 'PermissionSet', 'S' || (k % 40), change_kind from s""")
def handler_elements_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of files that are parts of others: versions of bots, and settings of permission sets."""
    paths = ("concat('src/bots/B', k % 30, '/v', k, '.botVersion-meta.xml')", "concat('src/permissionsets/S', k % 40, '/objectSettings/o', k, '.objectSettings-meta.xml')")
    return collected(spark, *part_tree(spark, sf_dir, *paths)).elements


@query(f"with {_PART.format(kinds=11)} select 'flow_deleted' as code, 'F' || k as subject from c where kind = 2 and status = 'D'")
def handler_warnings_of_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted flows."""
    return collected(spark, *part_tree(spark, sf_dir, *FILES)).warnings


@query(f"""with {_PART.format(kinds=11)}
select path, type from (select kind, case kind when 0 then 'src/classes/C' || k || '.cls' when 1 then 'src/classes/C' || k || '.cls-meta.xml' when 3 then 'src/documents/f' || (k % 3) || '/d' || k || 'x.document'
    when 6 then 'src/objects/O' || k || '/O' || k || '.object-meta.xml' when 7 then 'src/objects/P' || k || '/fields/X' || k || '.field-meta.xml' when 10 then 'src/notes/N' || k || '.txt' end as path,
    case kind when 3 then 'Document' when 6 then 'CustomObject' when 7 then 'CustomField' when 10 then null else 'ApexClass' end as type from c) where path is not null
union all values ('Flow', 'Flow'), ('Nothing', null), ('x/classes/a/b.unknown', 'ApexClass'), ('x/lwc/classes/b.unknown', 'LightningComponentBundle')""")
def type_lookup_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files by suffix, by directory, where one that owns what is in it ends the search, and by name."""
    paths = D.snapshot_diff(*part_tree(spark, sf_dir, *FILES)).where(F.expr("path rlike '^src/(classes|documents|objects/[OP]|notes)'")).select("path")
    more = spark.createDataFrame([("Flow",), ("Nothing",), ("x/classes/a/b.unknown",), ("x/lwc/classes/b.unknown",)], "path string")
    return R.lookup(paths.unionByName(more), R.Registry.of(spark, TYPES))


@query(f"""with {_PART.format(kinds=11)} select case kind when 0 then 'src/classes/C' || k || '.cls' when 7 then 'src/objects/P' || k || '/fields/X' || k || '.field-meta.xml' end as path,
    case kind when 0 then 'c' || k || '.cls' when 7 then 'objectsp' || k || 'fieldsx' || k || '.field-meta.xml' end as comparison_name from c where kind in (0, 7)""")
def comparison_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names by which deletions meet additions: of composed types the whole place."""
    registry = R.Registry.of(spark, TYPES)
    paths = D.snapshot_diff(*part_tree(spark, sf_dir, *FILES)).where(F.expr("path rlike '(cls|field-meta.xml)$'")).select("path")
    return R.with_comparison_name(R.lookup(paths, registry), registry).select("path", "comparison_name")


# --- the whole delta

_MOVED = """
o as (select p_partkey as k, 'a/classes/C' || p_partkey || '.cls' as path, 1 as v from part where p_partkey % 5 <> 0),
n as (select p_partkey as k, case when p_partkey % 11 = 0 then 'b' else 'a' end || '/classes/C' || p_partkey || '.cls' as path, case when p_partkey % 3 = 0 then 2 else 1 end as v from part where p_partkey % 7 <> 0),
d as (select coalesce(o.path, n.path) as path, coalesce(o.k, n.k) as k, case when o.path is null then 'A' when n.path is null then 'D' when o.v <> n.v then 'M' end as status from o full join n on o.path = n.path),
kept as (select * from d where status is not null and not (status <> 'D' and path like '%/C1%') and not (status = 'D' and path like '%/C2%')),
left_over as (select * from kept x where status <> 'D' or not exists (select 1 from kept y where y.status = 'A' and y.k = x.k))
"""


def moved_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, name = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), F.expr("concat('/classes/C', k, '.cls')")
    row = lambda folder, v: [F.concat(folder, name).alias("path"), v.cast("string").alias("oid"), F.lit("100644").alias("mode")]
    old = k.where("k % 5 <> 0").select(*row(F.lit("a"), F.lit(1)))
    return old, k.where("k % 7 <> 0").select(*row(F.when(F.col("k") % 11 == 0, "b").otherwise("a"), F.when(F.col("k") % 3 == 0, 2).otherwise(1)))


def class_delta(spark: SparkSession, sf_dir: str, **options) -> object:
    own = Options(ignore=parse_rules("C1*"), ignore_destructive=parse_rules("C2*"), **options)
    return delta(*moved_classes(spark, sf_dir), R.Registry.of(spark, TYPES), own)


@query(f"with {_MOVED} select distinct 'ApexClass' as type, 'C' || k as member from left_over where status <> 'D'")
def delta_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole delta applies, under rules for additions and for deletions."""
    return class_delta(spark, sf_dir).package


@query(f"with {_MOVED} select distinct 'ApexClass' as type, 'C' || k as member from left_over where status = 'D' and k not in (select k from left_over where status <> 'D')")
def delta_destructive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole delta removes: moved files cancel their deletion."""
    return class_delta(spark, sf_dir).destructive


@query(f"""with {_MOVED}, files as (select distinct path from left_over where status <> 'D') select path from files union all select path || '-meta.xml' from files""")
def delta_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole delta copies."""
    return class_delta(spark, sf_dir).copies.select("path").distinct()


@query(f"""with {_MOVED}, named as (select distinct k, path from n where path like 'b/%')
select distinct 'package' as target, 'ApexClass' as type, 'C' || k as member, 'add' as change_kind from named
union select distinct 'destructive', 'ApexClass', 'C' || k, 'delete' from named where path like '%/C3%'""")
def delta_of_forced_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What include rules bring back where nothing else changed: additions since the first commit, and deletions."""
    _, new = moved_classes(spark, sf_dir)
    options = Options(include=parse_rules("b/"), include_destructive=parse_rules("/b/classes/C3*"), generate_delta=False)
    return delta(new, new, R.Registry.of(spark, TYPES), options, first=S.empty_snapshot(spark)).elements


# --- documents of customers, one for each forty

_CUSTOMERS = """
one as (select c_custkey // 40 as n, c_custkey as k, 'A' || c_custkey as name, c_mktsegment as seg from customer),
o as (select * from one where k % 5 <> 0),
w as (select n, k, name, case when k % 3 = 0 then seg || '!' else seg end as seg from one where k % 7 <> 0),
b as (select coalesce(o.n, w.n) as n, coalesce(o.k, w.k) as k, coalesce(o.name, w.name) as name, w.seg, case when o.k is null then 'add' when w.k is null then 'delete' when o.seg <> w.seg then 'modify' end as kind from o full join w on o.k = w.k)
"""


def customer_files(spark: SparkSession, sf_dir: str, root: str, tag: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, new, blobs): an XML document for each forty customers with these as children, in order of their keys."""
    one = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 40).alias("n"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))

    def files(rows: DataFrame, seg: Column) -> DataFrame:
        child = F.concat(F.lit(f"<{tag}><fullName>A"), F.col("k").cast("string"), F.lit("</fullName><text>"), seg, F.lit(f"</text></{tag}>"))
        docs = rows.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", child.alias("x")))), lambda s: s["x"]), "").alias("x"))
        return docs.select(F.expr(path).alias("path"), F.concat(F.lit(f"<{root}>"), "x", F.lit(f"</{root}>")).alias("content"))

    changed = F.when(F.col("k") % 3 == 0, F.concat("seg", F.lit("!"))).otherwise(F.col("seg"))
    (old, a), (new, b) = S.from_table(files(one.where("k % 5 <> 0"), F.col("seg"))), S.from_table(files(one.where("k % 7 <> 0"), changed))
    return old, new, a.unionByName(b).dropDuplicates(["oid"])


_WORKFLOWS = ("Workflow", "alerts", "concat('src/workflows/W', n, '.workflow-meta.xml')")


@query(f"""with {_CUSTOMERS} select case kind when 'delete' then 'destructive' else 'package' end as target, 'WorkflowAlert' as type, 'W' || n || '.' || name as member, kind as change_kind from b where kind is not null
union all select distinct 'package', 'Workflow', 'W' || n, 'modify' from b where kind in ('add', 'modify')""")
def handler_elements_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements inside changed documents, and the documents that have something left to send."""
    return collected(spark, *customer_files(spark, sf_dir, *_WORKFLOWS)).elements


@query(f"""with {_CUSTOMERS} select 'src/workflows/W' || n || '.workflow-meta.xml' as path, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Workflow>' || chr(10) ||
    string_agg('    <alerts>' || chr(10) || '        <fullName>' || name || '</fullName>' || chr(10) || '        <text>' || seg || '</text>' || chr(10) || '    </alerts>' || chr(10), '' order by k) || '</Workflow>' || chr(10)) as digest
from b where kind in ('add', 'modify') group by n""")
def pruned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are sent, with what changed in them alone."""
    files = collected(spark, *customer_files(spark, sf_dir, *_WORKFLOWS)).copies.where("kind = 'computed'")
    return files.select("path", F.md5("content").alias("digest"))


@query(f"""with {_CUSTOMERS} select case kind when 'delete' then 'destructive' else 'package' end as target, 'CustomLabel' as type, name as member, kind as change_kind from b where kind is not null""")
def handler_elements_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels inside changed documents stand for themselves."""
    return collected(spark, *customer_files(spark, sf_dir, "CustomLabels", "labels", "concat('src/labels/L', n, '.labels-meta.xml')")).elements


@query(f"""with {_CUSTOMERS} select 'src/workflows/W' || n || '.workflow-meta.xml' as doc, 'alerts' as tag, row_number() over (partition by n order by k) as pos,
    '{{"fullName": "' || name || '", "text": "' || seg || '"}}' as value from w""")
def xml_root_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of each document's root, in order."""
    _, new, blobs = customer_files(spark, sf_dir, *_WORKFLOWS)
    docs = S.files_with_content(new, blobs, "src/workflows").select(F.col("path").alias("doc"), "content")
    return children_of(docs).where("pos > 0").select("doc", "tag", "pos", "value")


@query(f"""with {_CUSTOMERS}, r as (select *, row_number() over (partition by n order by k) as pos from w), broken as (select distinct n from w where n % 3 = 0)
select true as lenient, n, count(*) as children, 0 as errors from r where n not in (select n from broken) or pos <= 2 group by n
union all select false, n, case when n in (select n from broken) then 0 else count(*) end, case when n in (select n from broken) then 1 else 0 end from r group by n""")
def malformed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and errors of documents of which a third end after two children and a half: read strictly and leniently."""
    _, new, blobs = customer_files(spark, sf_dir, "Workflow", "alerts", "concat('w/', n)")
    docs = S.files_with_content(new, blobs).select(F.expr("cast(substring(path, 3) as int)").alias("doc"), F.col("content").cast("string").alias("content"))
    short = F.expr("concat(substring_index(content, '</alerts>', 2), '</alerts><alerts><fullName>')")
    docs = docs.select("doc", F.when(F.col("doc") % 3 == 0, short).otherwise(F.col("content")).alias("content"))
    counts = lambda lenient: children_of(docs, lenient).groupBy("doc").agg(F.count_if(F.col("pos") > 0).alias("children"), F.count("error").cast("int").alias("errors")).select(F.lit(lenient).alias("lenient"), F.col("doc").alias("n"), "children", "errors")
    return counts(True).unionByName(counts(False))


@query(f"""with {_CUSTOMERS}
select n, n % 3 = 0 as malformed, case when n % 3 = 0 then 0 else count(*) end as children, case when n % 3 <> 0 then min_by(name, k) end as first from w group by n""")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one value each, of which a third lack their end and are empty objects."""
    _, new, blobs = customer_files(spark, sf_dir, "Workflow", "alerts", "concat('w/', n)")
    docs = S.files_with_content(new, blobs).select(F.expr("cast(substring(path, 3) as bigint)").alias("doc"), F.col("content").cast("string").alias("content"))
    docs = docs.select("doc", F.when(F.col("doc") % 3 == 0, F.expr("substring(content, 1, length(content) - 4)")).otherwise(F.col("content")).alias("content"))
    alerts = F.get_json_object("value", "$.Workflow.alerts")
    first = F.coalesce(F.get_json_object("value", "$.Workflow.alerts[0].fullName"), F.get_json_object("value", "$.Workflow.alerts.fullName"))
    many = F.when(alerts.startswith("["), F.json_array_length(alerts).cast("long")).when(alerts.isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return xml_whole(docs).select(F.col("doc").alias("n"), (F.col("value") == "{}").alias("malformed"), many.alias("children"), first.alias("first"))


@query(f"""with {_CUSTOMERS}, own as (select n, name, k from w where k % 2 = 0), known as (select n, name, k from o where k % 4 = 0), mixed as (
    select n, name, k, 0 as late from known union all select n, name, k, 1 from own where not exists (select 1 from known where known.n = own.n and known.name = own.name))
select 'T' || n || '.translation-meta.xml' as doc, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || case when n in (select n from known) then '<Translations>' else '<Translations xmlns="http://soap.sforce.com/2006/04/metadata">' end || chr(10) ||
    string_agg('    <flowDefinitions>' || chr(10) || '        <fullName>' || name || '</fullName>' || chr(10) || '    </flowDefinitions>' || chr(10), '' order by late, k) || '</Translations>' || chr(10)) as digest
from mixed where n in (select n from own) group by n""")
def merged_flow_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow definitions of packaged flows, behind those that the output already has."""
    one = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 40).alias("n"), F.col("c_custkey").alias("k"))

    def files(rows: DataFrame) -> DataFrame:
        child = F.concat(F.lit("<flowDefinitions><fullName>A"), F.col("k").cast("string"), F.lit("</fullName></flowDefinitions>"))
        docs = rows.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", child.alias("x")))), lambda s: s["x"]), "").alias("x"))
        return docs.select(F.concat(F.lit("T"), F.col("n").cast("string"), F.lit(".translation-meta.xml")).alias("doc"), F.concat(F.lit("<Translations>"), "x", F.lit("</Translations>")).alias("content"))

    flows = one.where("k % 2 = 0").select(F.lit("package").alias("target"), F.lit("Flow").alias("type"), F.concat(F.lit("A"), F.col("k").cast("string")).alias("member"), F.lit("add").alias("change_kind"))
    _, own = collectors.flow_translations(flows, children_of(files(one.where("k % 7 <> 0")), lenient=True))
    return collectors.merged_translations(own, files(one.where("k % 5 <> 0 and k % 4 = 0"))).select("doc", F.md5("content").alias("digest"))


# --- sources, registries, outputs


@query("""select cast(doc_id as varchar) as path, sha1(encode('blob ' || octet_length(encode(coalesce(text, '')))) || '\\x00'::blob || encode(coalesce(text, ''))) as oid, '100644' as mode from documents where doc_id is not null""")
def table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a snapshot, with object ids of their contents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return S.from_table(docs)[0]


@query("""with there as (select sha256(coalesce(text, '')) as sha from documents where doc_id % 6 = 0)
select cast(doc_id as varchar) as oid, md5(case when doc_id % 3 <> 0 or sha256(coalesce(text, '')) in (select sha from there) then coalesce(text, '') else 'version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || sha256(coalesce(text, '')) || chr(10) || 'size 1' || chr(10) end) as digest
from documents where doc_id is not null""")
def large_file_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of which a third are pointers, about half of these to objects that are there."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    pointer = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), sha, F.lit("\nsize 1\n"))
    blobs = docs.select(F.col("doc_id").cast("string").alias("oid"), F.when(F.col("doc_id") % 3 == 0, pointer).otherwise(F.col("text")).cast("binary").alias("content"))
    objects = docs.where("doc_id % 6 = 0").select(sha.alias("sha256"), F.col("text").cast("binary").alias("content")).dropDuplicates(["sha256"])
    return S.with_lfs(blobs, objects).select("oid", F.md5("content").alias("digest"))


_COMMITS = "g as (select p_partkey as k, p from (select p_partkey, unnest([p_partkey // 2, p_partkey // 3]) as p from part) where p > 0)"


@query(f"""with recursive {_COMMITS}, h(k, depth) as (select max(p_partkey), 0 from part union select g.p, h.depth + 1 from h join g on g.k = h.k)
select cast(k as varchar) as id, min(depth) as depth from h group by k""")
def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits that the last one descends from, at their least depth: part k has the parents k/2 and k/3."""
    return S.history(part_commits(spark, sf_dir), str(table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]))


def part_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.expr("transform(filter(array(p_partkey div 2, p_partkey div 3), p -> p > 0), p -> cast(p as string))")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), parents.alias("parents"))


@query(f"""with recursive {_COMMITS}, m as (select max(p_partkey) as k from part), a(k) as (select k from m union select g.p from a join g on g.k = a.k),
b(k) as (select k - 1 from m union select g.p from b join g on g.k = b.k),
x as (select k from a intersect select k from b)
select (select min(cast(k as varchar)) from x where k not in (select g.p from g join x on x.k = g.k)) as merge_base, '1' as first_commit""")
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A best common commit of the last two, and the first of all."""
    commits, last = part_commits(spark, sf_dir), table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return spark.createDataFrame([(S.merge_base(commits, str(last), str(last - 1)), S.first_commit(commits, str(last)))], "merge_base string, first_commit string")


_EVENT_COMMITS = """
g as (
    select event_id as k, p from (select event_id, unnest(case when event_id % 400 = 1 then [] when event_id % 100 = 7 then [event_id - 1, event_id - 390] else [event_id - 1] end) as p from events)
    where p in (select event_id from events)
)
"""


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a commit on the one before it; a history begins anew every 400, and some merge one far back, which may be of another."""
    parents = F.when(F.col("event_id") % 400 == 1, F.array().cast("array<long>")).when(F.col("event_id") % 100 == 7, F.array(F.col("event_id") - 1, F.col("event_id") - 390)).otherwise(F.array(F.col("event_id") - 1))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), parents.cast("array<string>").alias("parents"))


@query(f"""with recursive {_EVENT_COMMITS}, s as (select max(event_id) as k from events union select max(event_id) - 150 from events),
a(s, k) as (select k, k from s union select a.s, g.p from a join g on g.k = a.k)
select cast(s as varchar) as start, cast(k as varchar) as id from a""")
def commit_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits that two commits descend from, over chains of first parents."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return T.ancestors(T.chains(event_commits(spark, sf_dir)), spark.createDataFrame([(str(last),), (str(last - 150),)], "id string"))


@query(f"""with recursive {_EVENT_COMMITS}, s as (select max(event_id) as k from events union select max(event_id) - 5 from events),
a(s, k) as (select k, k from s union select a.s, g.p from a join g on g.k = a.k),
x as (select k from a group by k having count(*) = 2)
select cast(k as varchar) as id from x where k not in (select g.p from g join x on x.k = g.k)""")
def common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best common commits of the last event and the fifth before it."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return T.best_common_ancestors(event_commits(spark, sf_dir), str(last), str(last - 5))


_ORDER_FILES = """
file as (select strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey as path, o_orderkey as k, month(o_orderdate) as m, o_orderstatus || o_custkey as v from orders),
o as (select path, v from file where not (k % 11 = 0 and m in (2, 3))),
n as (select path, case when k % 7 = 0 and m = 3 then v || 'x' else v end as v from file where not (k % 13 = 0 and k % 11 <> 0 and m in (3, 7)))
"""


def order_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    """The trees of two revisions of orders as files below year, month and day, and their roots; they differ in some months."""
    k, m = F.col("o_orderkey"), F.month("o_orderdate")
    path = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"), k.cast("string"))
    orders = table(spark, sf_dir, "orders").select(path.alias("path"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("oid"), F.lit("100644").alias("mode"), k.alias("k"), m.alias("m"))
    old = orders.where("not (k % 11 = 0 and m in (2, 3))").select(F.lit("old").alias("revision"), "path", "oid", "mode")
    new = orders.where("not (k % 13 = 0 and k % 11 <> 0 and m in (3, 7))")
    new = new.select(F.lit("new").alias("revision"), "path", F.expr("if(k % 7 = 0 and m = 3, concat(oid, 'x'), oid)").alias("oid"), "mode")
    trees, roots = T.trees_of(old.unionByName(new))
    return trees, {r.revision: r.tree for r in roots.collect()}


@query(f"""with {_ORDER_FILES} select coalesce(o.path, n.path) as path, case when o.path is null then 'A' when n.path is null then 'D' else 'M' end as status, o.v as old_oid, n.v as new_oid
from o full join n on o.path = n.path where o.v is distinct from n.v""")
def hash_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two revisions of orders differ in, by a descent of their trees."""
    trees, roots = order_trees(spark, sf_dir)
    return T.tree_diff(trees, roots["old"], roots["new"]).changes


@query(f"with {_ORDER_FILES} select path, v as oid, '100644' as mode from n")
def hash_tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat snapshot of the newer of two revisions of orders."""
    trees, roots = order_trees(spark, sf_dir)
    return T.flatten(trees, roots["new"])


@query("""select 'p' || (page_id % 7) || '/' || page_id as path, '100644' as mode, octet_length(encode(coalesce(html, ''))) as bytes, md5(coalesce(html, '')) as digest
from pages where page_id % 7 in (1, 3)""")
def file_tree_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the folders that pages are written to as files, through the data source, which lists no others."""
    folder = f"{shared_folder(spark)}/driftledger/files-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    copies.write_files(pages.select(path.alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content")), folder)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    found = read_tree(spark, folder, ["p1", "p3"])
    return found.select("path", "mode", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


_STANDARD = """
s as (select n_nationkey as k, n_name as name, lower(n_name) as suffix, 'd' || n_regionkey as directory, n_nationkey % 4 = 0 as folder, n_nationkey % 3 as a from nation)
"""


def standard_registry(spark: SparkSession, sf_dir: str) -> dict:
    """A standard registry of the nations, some with folders, some with a child."""
    out = {}
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        key, name, suffix, directory = r["n_nationkey"], r["n_name"], r["n_name"].lower(), f"d{r['n_regionkey']}"
        own = {"name": name, "suffix": suffix, "directoryName": directory}
        own |= {"strategies": {"adapter": "bundle" if key % 3 == 1 else "other"}} if key % 3 else {}
        if key % 4 == 0:
            own |= {"inFolder": True, "folderType": f"f{key}"}
            out[f"f{key}"] = {"name": f"{name}Folder", "suffix": f"{suffix}Folder", "directoryName": directory}
        if key % 5 == 0:
            listed = {f"tag{key}": "c"} if key % 10 == 0 else {}
            own["children"] = {"directories": listed, "types": {"c": {"name": f"{name}Child", "suffix": suffix, "directoryName": directory, "xmlElementName": f"tag{key}", "uniqueIdElement": "id"}}}
        out[f"t{key}"] = own
    return out


@query(f"""with {_STANDARD} select name as xml_name, directory as directory_name, suffix, folder as in_folder, a = 1 as meta_file, cast(null as varchar) as parent,
    case when folder then 'in_folder' when a = 1 then 'in_resource' when k % 5 = 0 and a = 0 then 'in_file' else 'standard' end as handler from s
union all select name || 'Child', case when k % 10 = 0 then 'tag' || k end, case when k % 10 = 0 then suffix end, false, false, name, case when a = 0 then 'decomposed' else 'standard' end from s where k % 5 = 0""")
def registry_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, and who handles them, of a standard registry of the nations."""
    types = R.from_standard(standard_registry(spark, sf_dir))
    handler = R.handlers(types)
    rows = [(t.xml_name, t.directory_name, t.suffix, t.in_folder, t.meta_file, t.parent_xml_name, handler[t.xml_name]) for t in types]
    return spark.createDataFrame(rows, "xml_name string, directory_name string, suffix string, in_folder boolean, meta_file boolean, parent string, handler string")


@query(f"""with {_STANDARD} select 'tag' || k as tag, case when k % 10 = 0 then 'other' else 'id' end as key, name || 'Child' as xml_name, k % 10 = 0 as excluded from s where k % 5 = 0""")
def registry_overlay_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag rules of that registry, after an overlay for some of its children."""
    base = R.from_standard(standard_registry(spark, sf_dir))
    over = R.from_json([{"xmlName": t.xml_name, "key": "other", "excluded": True} for t in base if t.xml_tag and t.directory_name])
    return R.tag_rules(spark, R.overlay(base, over))


@query("""with m as (select case p_partkey % 3 when 0 then 'CustomObject' when 1 then 'alpha' else 'Beta' end as type, case when p_partkey % 2 = 0 then upper(to_hex(p_partkey)) else lower(to_hex(p_partkey)) end as member from part)
select row_number() over (order by type <> 'CustomObject', lower(type)) as place, type, string_agg(member, ',' order by lower(member)) as members from m group by type""")
def manifest_in_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest blocks in the order of a locale, which cases don't divide."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.hex(F.col("p_partkey").cast("long")).alias("h"))
    kind = F.when(F.col("k") % 3 == 0, "CustomObject").when(F.col("k") % 3 == 1, "alpha").otherwise("Beta")
    view = part.select(kind.alias("type"), F.when(F.col("k") % 2 == 0, F.upper("h")).otherwise(F.lower("h")).alias("member"))
    return C.manifest(view).select(F.col("place").cast("long").alias("place"), "type", F.array_join("members", ",").alias("members"))


def written(spark: SparkSession, name: str, write) -> DataFrame:
    """(line): the lines of the file of that name that write makes in a new folder."""
    folder = f"{shared_folder(spark)}/driftledger/written-{uuid.uuid4().hex}"
    write(folder)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.text(f"{folder}/{name}", wholetext=True).select(F.col("value").alias("text"))


@query("""with m as (select p_partkey, p_name || ' ' || p_partkey as member, 'Type' || (p_partkey % 7) as type from part),
b as (select type, '    <types>' || chr(10) || string_agg('        <members>' || replace(replace(replace(member, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</members>' || chr(10), '' order by lower(member)) || '        <name>' || type || '</name>' || chr(10) || '    </types>' || chr(10) as x from m group by type)
select '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Package xmlns="http://soap.sforce.com/2006/04/metadata">' || chr(10) || string_agg(x, '' order by lower(type)) || '    <version>61.0</version>' || chr(10) || '</Package>' as text from b""")
def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the parts as tasks write it."""
    view = table(spark, sf_dir, "part").select(F.concat(F.lit("Type"), (F.col("p_partkey") % 7).cast("string")).alias("type"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("member"))
    return written(spark, "package.xml", lambda folder: sinks.write_manifest(view, 61, folder, "package.xml"))


_REVIEW = """
own as (select case p_partkey % 4 when 0 then 'add' when 1 then 'delete' else 'rename' end as kind, p_type as type, p_name || ' "' || p_partkey || chr(9) || '\\' as member, 'to ' || (p_partkey * 7919 % 100003) || '-' || p_partkey as goal from part),
esc as (select kind, type, member, goal, '"' || replace(replace(replace(member, '\\', '\\\\'), '"', '\\"'), chr(9), '\\t') || '"' as j from own),
entry as (select kind, type, case when kind = 'rename' then goal else member end as place, case when kind = 'rename' then '      {' || chr(10) || '        "from": ' || j || ',' || chr(10) || '        "to": "' || goal || '"' || chr(10) || '      }' else '      ' || j end as x from esc),
types as (select kind, type, '    "' || type || '": [' || chr(10) || string_agg(x, ',' || chr(10) order by place) || chr(10) || '    ]' as x from entry group by kind, type),
kinds as (select k, kind, coalesce((select '  "' || v.kind || '": {' || chr(10) || string_agg(x, ',' || chr(10) order by type) || chr(10) || '  }' from types t where t.kind = v.kind), '  "' || kind || '": {}') as x from (values (1, 'add'), (2, 'modify'), (3, 'delete'), (4, 'rename')) v(k, kind))
"""


@query(f"with {_REVIEW} select '{{' || chr(10) || string_agg(x, ',' || chr(10) order by k) || chr(10) || '}}' as text from kinds")
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review file of the parts, some added, some deleted, half renamed, as tasks write it."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "add").when(k % 4 == 1, "delete").otherwise("rename")
    member, goal = F.concat("p_name", F.lit(' "'), k.cast("string"), F.lit("\t\\")), F.concat(F.lit("to "), (k * 7919 % 100003).cast("string"), F.lit("-"), k.cast("string"))
    kinds = table(spark, sf_dir, "part").select(kind.alias("kind"), F.col("p_type").alias("type"), member.alias("member"), F.when(kind == "rename", goal).alias("to_member"))
    return written(spark, "changes.json", lambda folder: sinks.write_review(kinds, folder))


@query(f"""with {_PAGES}, dirs as (select distinct array_to_string(string_split(path, '/')[:-2], '/') as dir from n where path like 'www.%'),
files as (select path from n where exists (select 1 from dirs where starts_with(n.path, dir || '/')))
select path, count(*) as n from files group by path""")
def expanded_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of directories as copies of the files below them."""
    _, new = page_snapshots(spark, sf_dir)
    asked = new.where("path like 'www.%'").select(P.dir_name(F.col("path")).alias("path"), F.lit("directory").alias("kind"), F.lit(0).alias("seq")).distinct()
    return copies.expand_directories(asked, new).select("path").distinct().withColumn("n", F.lit(1).cast("long"))


@query(f"""with {_PAGES} select n.path, md5(p.html) as digest from n join page p on n.path = p.path where n.path not like '%/fr/%' and page_id % 4 <> 1""")
def copied_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the files to copy that the rules keep, by object id; files without one are passed over."""
    _, new = page_snapshots(spark, sf_dir)
    blobs = page_paths(spark, sf_dir).select("oid", F.col("html").alias("content")).where("oid is not null").dropDuplicates(["oid"])
    asked = new.select("path", F.lit("file").alias("kind"), F.lit(0).alias("seq"))
    return copies.with_content(copies.kept_copies(asked, parse_rules("fr/")), new, blobs).select("path", F.md5("content").alias("digest"))


@query(f"""with {_PAGES}, h as (select min(split_part(path, '/', 1)) as host from n) select path from n, h where starts_with(path, host || '/')""")
def files_below_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files below the first host."""
    _, new = page_snapshots(spark, sf_dir)
    return E.files_under(new, new.agg(F.min(F.substring_index("path", "/", 1))).first()[0]).select("path")


@query(f"""with {_PAGES} select count(*) as "rows" from d where status is not null""")
def observed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes there are, counted as they pass."""
    seen = Observation()
    D.counted(D.snapshot_diff(*page_snapshots(spark, sf_dir)), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


@query(f"with {_ELEMENTS} select distinct 'bundle_deletion' as code, member as subject from e where target = 'destructive' and type = (select min(type) from e)")
def bundle_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bundles: the members of the first brand."""
    elements = part_elements(spark, sf_dir)[0]
    return C.bundle_warnings(elements, elements.agg(F.min("type")).first()[0])


@query(f"with {_ELEMENTS} select (select count(*) from package) + (select count(*) from e where target = 'destructive') = 0 as everything, true as nothing")
def empty_changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is nothing to do: of all elements, and of none."""
    elements, renames = part_elements(spark, sf_dir)
    return spark.createDataFrame([(C.is_empty(elements, renames), C.is_empty(elements.limit(0), renames.limit(0)))], "everything boolean, nothing boolean")


@query("""select event_id, event_id % 3 <> 0 as equal from events where props is not null""")
def unequal_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties against themselves with another key order, in a third of them with one key more."""
    events = table(spark, sf_dir, "events").where("props is not null")
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    more = F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.lit("added").alias("key"), F.lit("1").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    turned = F.to_json(F.map_from_entries(F.concat(F.reverse(pairs), more)))
    return events.select("event_id", X.canonical(turned).eqNullSafe(X.canonical(F.to_json(F.map_from_entries(pairs)))).alias("equal"))


@query("""select l_orderkey as doc, count(*) as n from lineitem group by l_orderkey""")
def bounded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as children, none of whose documents has too many."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("line").alias("tag"))
    return X.require_bounded(lines).groupBy("doc").agg(F.count("*").alias("n"))


@query("""select doc_id as doc, case when doc_id % 2 = 0 then true else false end as has_package_content from documents where doc_id is not null""")
def texts_that_are_no_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose one child is text, with a repeated key or none: those with another text are sent."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 3 == 0, "keyed").otherwise("plain").alias("tag"), F.lit(1).alias("pos"))
    value = lambda v: F.when(F.col("tag") == "plain", F.concat(F.lit("not json "), v)).otherwise(F.concat(F.lit('{"name":"a","v":"'), v, F.lit('","v":"1"}'))).alias("value")
    rules = spark.createDataFrame([("keyed", None, "Keyed", False)], "tag string, key string, xml_name string, excluded boolean")
    old, new = docs.select("*", value(F.lit("0"))), docs.select("*", value(F.when(F.col("doc") % 2 == 0, "1").otherwise("0")))
    return X.document_diff(old, new, rules).documents
