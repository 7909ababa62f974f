"""Configuration trees and metadata exports in XML: files become records, joins put them together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders of a configuration tree and the kind of object each holds.
KINDS = {
    "Catalogs": "Catalog",
    "Documents": "Document",
    "DocumentJournals": "DocumentJournal",
    "Enums": "Enum",
    "Reports": "Report",
    "DataProcessors": "DataProcessor",
    "ChartsOfCharacteristicTypes": "ChartOfCharacteristicTypes",
    "ChartsOfAccounts": "ChartOfAccounts",
    "ChartsOfCalculationTypes": "ChartOfCalculationTypes",
    "InformationRegisters": "InformationRegister",
    "AccumulationRegisters": "AccumulationRegister",
    "AccountingRegisters": "AccountingRegister",
    "CalculationRegisters": "CalculationRegister",
    "BusinessProcesses": "BusinessProcess",
    "Tasks": "Task",
    "ExchangePlans": "ExchangePlan",
    "ExternalDataSources": "ExternalDataSource",
    "Constants": "Constant",
    "CommonModules": "CommonModule",
    "SessionParameters": "SessionParameter",
    "FilterCriteria": "FilterCriterion",
    "ScheduledJobs": "ScheduledJob",
    "FunctionalOptions": "FunctionalOption",
    "FunctionalOptionsParameters": "FunctionalOptionsParameter",
    "SettingsStorages": "SettingsStorage",
    "EventSubscriptions": "EventSubscription",
    "CommandGroups": "CommandGroup",
    "Roles": "Role",
    "Interfaces": "Interface",
    "Styles": "Style",
    "WebServices": "WebService",
    "HTTPServices": "HTTPService",
    "WSReferences": "WSReference",
    "IntegrationServices": "IntegrationService",
    "Subsystems": "Subsystem",
    "Sequences": "Sequence",
    "DefinedTypes": "DefinedType",
    "CommonForms": "CommonForm",
    "CommonTemplates": "CommonTemplate",
    "CommonPictures": "CommonPicture",
    "CommonCommands": "CommonCommand",
}
# Groups of an object's child elements.
GROUPS = {"Attribute": "requisites", "Dimension": "dimensions", "Resource": "resources", "AccountingFlag": "properties", "ExtDimensionAccountingFlag": "properties", "EnumValue": "values"}
_ROW = "rel_path string, row string, `group` string, name string, synonym string, type string, section string, version string"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        e = next((c for c in (e if e is not None else ()) if _tag(c) == n), None)
    return e


def _text(e: ET.Element | None) -> str:
    return (e.text or "").strip() if e is not None else ""


def _synonym(props: ET.Element | None) -> str:
    found = {_text(_child(i, "lang")): _text(_child(i, "content")) for i in (_child(props, "Synonym") or ())}
    return found.get("ru") or next(iter(found.values()), "")


def _types(e: ET.Element) -> str:
    kinds = _child(_child(e, "Properties"), "Type")
    return " | ".join(dict.fromkeys(_text(t) for t in (kinds.iter() if kinds is not None else ()) if _tag(t) == "Type" and _text(t)))


_DTD = re.compile(rb"\A(?:\xef\xbb\xbf)?(?>\s+|<\?.*?\?>|<!--.*?-->)*+<!DOCTYPE", re.S)


def parsed(content: bytes) -> list[tuple[str, str, str, str, str, str, str]]:
    """(row, group, name, synonym, type, section, version) of one XML file; malformed files and those with a DTD give none."""
    if _DTD.match(content):
        return []
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    named = lambda e: _text(_child(e, "Properties", "Name")) or (e.get("name") or "").strip()
    if _tag(root) == "Form":
        parts = (("Attributes", "Attribute", "form_attributes"), ("Commands", "Command", "form_commands"))
        return [("field", g, c.get("name") or "", "", "", "", "") for box, one, g in parts for c in (_child(root, box) or ()) if _tag(c) == one and c.get("name")]
    own = next(iter(root), root) if _tag(root) == "MetaDataObject" else root
    props = _child(own, "Properties")
    rows = [("object", _tag(own), _text(_child(props, "Name")), _synonym(props), "", "", _text(_child(props, "Version")))]
    for c in _child(own, "ChildObjects") or ():
        name, note = named(c), _synonym(_child(c, "Properties"))
        if name and _tag(c) == "TabularSection":
            rows.append(("field", "tabular_sections", name, note, "", "", ""))
            inner = [a for a in (_child(c, "ChildObjects") or ()) if _tag(a) == "Attribute" and named(a)]
            rows += [("field", "tabular_section_requisites", named(a), _synonym(_child(a, "Properties")), _types(a), name, "") for a in inner]
        elif name and _tag(c) in GROUPS:
            rows.append(("field", GROUPS[_tag(c)], name, note, _types(c), "", ""))
    return rows


def crawl(files: DataFrame) -> DataFrame:
    """The records of every XML file of a configuration tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["rel_path"], b["content"], strict=True) for r in parsed(bytes(c))]
            yield pd.DataFrame(rows, columns=["rel_path", "row", "group", "name", "synonym", "type", "section", "version"])

    return files.where(F.lower("rel_path").endswith(".xml")).select("rel_path", "content").mapInPandas(run, _ROW)


def config_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a configuration and lie in no other one's folder."""
    roots = files.where(F.col("rel_path").rlike("(^|/)Configuration[.]xml$")).select(F.regexp_replace("rel_path", "Configuration[.]xml$", "").alias("root"))
    above = roots.select(F.col("root").alias("outer"))
    parts = F.transform(F.sequence(F.lit(0), F.size(F.split("root", "/")) - 2), lambda n: F.concat(F.array_join(F.slice(F.split("root", "/"), F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")))
    inside = roots.where("root <> ''").select("root", F.explode(F.when(F.size(F.split("root", "/")) >= 2, parts)).alias("outer")).join(above, "outer").select("root").distinct()
    return roots.join(inside, "root", "left_anti")


def identity(records: DataFrame) -> DataFrame:
    """Name and version of a configuration; a missing version is 0.0.0.0."""
    own = records.where((F.col("rel_path") == "Configuration.xml") & (F.col("row") == "object"))
    return own.select(F.col("name").alias("config_name"), F.coalesce(F.nullif("version", F.lit("")), F.lit("0.0.0.0")).alias("config_version"))


def _kind_of(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.substring_index(path, "/", 1))


def objects(records: DataFrame) -> DataFrame:
    """One row per object file of a known folder: id, object_type, name, full_name, path."""
    own = records.where((F.col("row") == "object") & F.col("rel_path").rlike("^[^/]+/[^/]+[.]xml$")).withColumn("object_type", _kind_of(F.col("rel_path")))
    name = F.regexp_extract("rel_path", "^[^/]+/(.*)[.]xml$", 1)
    key = F.concat_ws(".", "object_type", name)
    return own.where("object_type is not null").select(key.alias("id"), "object_type", name.alias("name"), F.col("synonym").alias("full_name"), key.alias("path"))


def fields(records: DataFrame) -> DataFrame:
    """Fields of objects, of their sections and of their forms."""
    part = r"^([^/]+)/([^/]+?)(?:[.]xml$|/)"
    rows = records.where("row = 'field'").withColumn("object_type", _kind_of(F.col("rel_path"))).where("object_type is not null")
    name = F.regexp_extract("rel_path", part, 2)
    return rows.select(
        F.concat_ws(".", "object_type", name).alias("object_id"), name.alias("object_name"), "object_type", "group", "name", "synonym",
        F.when(F.col("group") == "tabular_sections", "ТабличнаяЧасть").when(F.col("group") == "values", "ЗначениеПеречисления").when(F.col("group").startswith("form_"), "").otherwise("Реквизит").alias("kind"),
        "type", F.nullif(F.regexp_extract("rel_path", "/Forms/([^/]+)/", 1), F.lit("")).alias("form_name"), F.nullif("section", F.lit("")).alias("tabular_section"),
    )


# Object types of a metadata export, and groups of its fields by kind.
EXPORT_TYPES = {
    "Документ": "Document", "Справочник": "Catalog", "Перечисление": "Enum", "РегистрСведений": "InformationRegister", "РегистрНакопления": "AccumulationRegister",
    "РегистрБухгалтерии": "AccountingRegister", "РегистрРасчета": "CalculationRegister", "ПланСчетов": "ChartOfAccounts", "ПланВидовХарактеристик": "ChartOfCharacteristicTypes",
    "ПланВидовРасчета": "ChartOfCalculationTypes", "ПланОбмена": "ExchangePlan", "БизнесПроцесс": "BusinessProcess", "ТочкаМаршрутаБизнесПроцесса": "RoutePoint", "Задача": "Task",
    "НаборКонстант": "ConstantsSet", "КонстантыНабор": "ConstantsSet", "ConstantsSet": "ConstantsSet", "Константа": "Constant", "Constant": "Constant",
}
EXPORT_GROUPS = {
    "Реквизит": "requisites", "Измерение": "dimensions", "Ресурс": "resources", "Свойство": "properties", "Константа": "requisites", "ТабличнаяЧасть": "tabular_sections",
    "ВидыСубконтоСчета": "properties", "ЭлементСоставаПланаОбмена": "properties", "СоставПланаОбмена": "properties",
}


def is_export(content: Column) -> Column:
    """Whether a file's first element is the root of a metadata export; prefixes, comments and the declaration aside."""
    head = F.substring(content, 1, 65536).cast("string")
    return F.coalesce(head.rlike(r"^\uFEFF?(?:\s|<\?[^>]*\?>|<!--(?:(?!-->)[\s\S])*+-->)*+<(?:[\w.-]+:)?Конфигурация[\s/>]"), F.lit(False))


def export_records(files: DataFrame) -> DataFrame:
    """(rel_path, tag, fields, types): each catalog record of an export, its child texts as a map, read in a stream.

    Files with a DTD give none; malformed ones give the records before the fault.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["rel_path"], b["content"], strict=True):
                rows, parser = [], ET.XMLPullParser(("end",))
                try:
                    parser.feed(b"" if _DTD.match(bytes(content)) else bytes(content))
                except ET.ParseError:
                    pass
                for _, e in parser.read_events():
                    if _tag(e).startswith("CatalogObject."):
                        kinds = [_text(t) for k in (_child(e, "Типы") or ()) for t in k if _tag(t) == "Тип" and _text(t)]
                        rows.append((path, _tag(e).removeprefix("CatalogObject."), {_tag(c): _text(c) for c in e}, kinds))
                        e.clear()
                yield pd.DataFrame(rows, columns=["rel_path", "tag", "fields", "types"])

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, tag string, fields map<string,string>, types array<string>")


def export_objects(records: DataFrame) -> DataFrame:
    """Objects of known types: ref, id, object_type, name, full_name, comment."""
    kinds = F.create_map(*[F.lit(x) for pair in EXPORT_TYPES.items() for x in pair])
    f = lambda k: F.trim(F.coalesce(F.col("fields")[k], F.lit("")))
    name = F.coalesce(F.nullif(f("Имя"), F.lit("")), f("Description"))
    rows = records.where("tag = 'Объекты'").select(
        "rel_path", f("Ref").alias("ref"), F.try_element_at(kinds, f("Тип")).alias("object_type"), name.alias("name"), f("Синоним").alias("full_name"), f("Комментарий").alias("comment")
    )
    return rows.where("object_type is not null and ref <> '' and name <> ''").withColumn("id", F.concat_ws(".", "object_type", "name"))


def export_fields(records: DataFrame) -> DataFrame:
    """Fields with owner (misses go), section (misses stay on top level), group and resolved types (misses keep the id)."""
    groups = F.create_map(*[F.lit(x) for pair in EXPORT_GROUPS.items() for x in pair])
    f = lambda k: F.trim(F.coalesce(F.col("fields")[k], F.lit("")))
    name = F.coalesce(F.nullif(f("Имя"), F.lit("")), f("Description"))
    owners = export_objects(records).select("rel_path", F.col("ref").alias("_owner"), F.col("id").alias("object_id"), F.col("name").alias("object_name"), "object_type")
    props = records.where("tag = 'Свойства'").select(
        "rel_path", f("Ref").alias("ref"), f("Owner").alias("_owner"), f("Parent").alias("_parent"), f("Вид").alias("kind"), name.alias("name"), f("Синоним").alias("synonym"), f("Комментарий").alias("comment"), "types"
    )
    names = records.where(f("Ref") != "").select("rel_path", f("Ref").alias("_type"), F.coalesce(F.nullif(name, F.lit("")), f("Синоним")).alias("_name"))
    resolved = (
        props.select("rel_path", "ref", F.posexplode("types").alias("_k", "_type")).join(names, ["rel_path", "_type"], "left")
        .groupBy("rel_path", "ref").agg(F.array_sort(F.collect_list(F.struct("_k", F.coalesce(F.nullif("_name", F.lit("")), "_type").alias("t")))).alias("_t"))
        .select("rel_path", "ref", F.array_distinct("_t.t").alias("types"))
    )
    sections = props.where("kind = 'ТабличнаяЧасть'").select("rel_path", F.col("ref").alias("_parent"), F.col("name").alias("tabular_section"))
    joined = props.drop("types").join(owners, ["rel_path", "_owner"]).join(sections, ["rel_path", "_parent"], "left").join(resolved, ["rel_path", "ref"], "left")
    group = F.when(F.col("tabular_section").isNotNull(), "tabular_section_requisites").otherwise(F.coalesce(F.try_element_at(groups, F.col("kind")), F.lit("properties")))
    constant = F.when(F.col("object_type") == "Constant", F.col("object_name")).when((F.col("object_type") == "ConstantsSet") & F.col("kind").isin("Константа", "Реквизит", "Свойство"), F.col("name"))
    made = joined.select(
        "object_id", "object_name", "object_type", group.alias("group"), "name", "synonym", "comment", "kind", F.coalesce("types", F.array().cast("array<string>")).alias("types"), "tabular_section",
        F.when(constant.isNotNull(), F.concat(F.lit("Константы."), constant, F.lit(".Получить()"))).alias("constant_bsl_hint"),
    )
    values = records.where("tag = 'Значения'").select("rel_path", f("Owner").alias("_owner"), name.alias("name"), f("Синоним").alias("synonym"), f("Комментарий").alias("comment")).join(owners, ["rel_path", "_owner"])
    listed = values.select("object_id", "object_name", "object_type", F.lit("values").alias("group"), "name", "synonym", "comment", F.lit("ЗначениеПеречисления").alias("kind"))
    return made.withColumn("type", F.coalesce(F.get("types", F.lit(0)), F.lit(""))).unionByName(listed, allowMissingColumns=True)


def export_profile(records: DataFrame) -> DataFrame:
    """(measure, key, n): records by tag, object types, property kinds, and how many owners are missing."""
    f = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    tags = records.groupBy(F.lit("tag").alias("measure"), F.col("tag").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    types = records.where("tag = 'Объекты'").groupBy(F.lit("object_type").alias("measure"), f("Тип").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    kinds = records.where("tag = 'Свойства'").groupBy(F.lit("property_kind").alias("measure"), f("Вид").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    refs = export_objects(records).select(F.col("ref").alias("_ref"))
    missing = records.where("tag = 'Свойства'").select(f("Owner").alias("_o")).join(refs, F.col("_o") == F.col("_ref"), "left_anti")
    return tags.unionByName(types).unionByName(kinds).unionByName(missing.agg(F.lit("missing").alias("measure"), F.lit("owner").alias("key"), F.count(F.lit(1)).alias("n")))
