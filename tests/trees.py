"""A small registry and snapshots for the tests."""

from driftledger.operators.registry import Registry, TypeDef
from driftledger.sources.snapshots import from_table

TYPES = [
    TypeDef("ApexClass", directory_name="classes", suffix="cls", meta_file=True),
    TypeDef("Flow", directory_name="flows", suffix="flow"),
    TypeDef("CustomObject", directory_name="objects", suffix="object", decomposition="folderPerType"),
    TypeDef("CustomField", directory_name="fields", suffix="field", parent_xml_name="CustomObject", xml_tag="fields", key="fullName"),
    TypeDef("RecordType", directory_name="recordTypes", suffix="recordType", parent_xml_name="CustomObject", xml_tag="recordTypes", key="fullName"),
    TypeDef("Index", directory_name="indexes", suffix="index", parent_xml_name="CustomObject"),
    TypeDef("LightningComponentBundle", directory_name="lwc", adapter="bundle", meta_file=True),
    TypeDef("StaticResource", directory_name="staticresources", suffix="resource", adapter="mixedContent", meta_file=True),
    TypeDef("Report", directory_name="reports", suffix="report", in_folder=True, content=(("report", "Report"), ("reportFolder", "ReportFolder"))),
    TypeDef("Document", directory_name="documents", suffix="document", in_folder=True, meta_file=True),
    TypeDef("PermissionSet", directory_name="permissionsets", suffix="permissionset"),
    TypeDef("Workflow", directory_name="workflows", suffix="workflow"),
    TypeDef("WorkflowAlert", parent_xml_name="Workflow", xml_tag="alerts", key="fullName"),
    TypeDef("CustomLabel", directory_name="labels", suffix="labels", parent_xml_name="CustomLabels", xml_tag="labels", key="fullName"),
    TypeDef("CustomLabels"),
    TypeDef("Profile", directory_name="profiles", suffix="profile", prune_only=True),
    TypeDef("ProfileTabVisibility", parent_xml_name="Profile", xml_tag="tabVisibilities", key="tab", excluded=True),
    TypeDef("VirtualBot", directory_name="bots", meta_file=True, content=(("bot", "Bot"), ("botVersion", "BotVersion"))),
    TypeDef("DigitalExperienceBundle", directory_name="digitalExperiences", suffix="digitalExperience", adapter="digitalExperience"),
    TypeDef("Translations", directory_name="translations", suffix="translation", prune_only=True),
    TypeDef("CustomObjectTranslation", directory_name="objectTranslations", suffix="objectTranslation"),
    TypeDef("CustomFieldTranslation", suffix="disabled_fieldTranslation", parent_xml_name="CustomObjectTranslation", xml_tag="fields", key="name", excluded=True),
    TypeDef("FlowDefinitionTranslation", parent_xml_name="Translations", xml_tag="flowDefinitions", key="fullName", excluded=True),
]


def registry(spark):
    return Registry.of(spark, TYPES)


def snapshots(spark, old, new):
    """(old, new, blobs) of two dicts of path to content."""
    schema = "path string, content string"
    a, ab = from_table(spark.createDataFrame(list(old.items()), schema))
    b, bb = from_table(spark.createDataFrame(list(new.items()), schema))
    return a, b, ab.unionByName(bb).dropDuplicates(["oid"])
