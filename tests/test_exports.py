"""Metadata exports read by record, snapshots, and the inputs of metadata packs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from packwright import cli
from packwright.plans import metadata, packs
from packwright.sources import config_xml, exports


def rec(tag, prefix="", **f):
    inner = "".join(f"<{k}>{v}</{k}>" for k, v in f.items())
    return f"<{prefix}CatalogObject.{tag} a:b='<not a tag' x=\"1\">{inner}</{prefix}CatalogObject.{tag}>".replace("'<not", "'not")


def export(n, prefix="", name="Conf", version="1.2"):
    rows = [rec("Конфигурации", prefix, Имя=name, Версия=version)]
    for k in range(n):
        rows.append(rec("Объекты", prefix, Ref=f"o{k}", Тип=("Документ", "Справочник", "Константа", "Прочее")[k % 4], Имя=f"N{k}", Синоним="A &amp; B", Комментарий="c <!-- no --> d"))
        rows.append(rec("Свойства", prefix, Ref=f"t{k}", Owner=f"o{k}", Вид="ТабличнаяЧасть", Имя="T"))
        rows.append(rec("Свойства", prefix, Ref=f"p{k}", Owner=f"o{k}", Parent=f"t{k}", Вид="Реквизит", Имя="B", Типы=f"<x:Строка><Тип>o{(k + 1) % n}</Тип></x:Строка><Строка><Тип>zz</Тип></Строка>"))
        rows.append(rec("Свойства", prefix, Ref=f"q{k}", Owner=f"o{k}", Вид="Измерение", Имя="Dim"))
        rows.append(rec("Значения", prefix, Owner=f"o{k}", Имя="V"))
    return f"<{prefix}Конфигурация Имя='Root' xmlns:a='a' xmlns:x='x' xmlns:v8='v'>\n" + "\n".join(rows) + f"\n</{prefix}Конфигурация>"


def as_rows(records):
    return sorted((r["tag"], sorted(r["fields"].items()), r["types"]) for r in records.collect())


def test_one_file_is_read_in_many_tasks(spark, tmp_path):
    path = tmp_path / "big.xml"
    path.write_text("<?xml version='1.0'?><!-- <x> -->\n" + export(3000), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        got = exports.export_records(spark, str(path))
        assert got.rdd.getNumPartitions() >= os.path.getsize(path) // (512 << 10) > 3
        whole = config_xml.export_records(spark.createDataFrame([("big.xml", bytearray(path.read_bytes()))], "rel_path string, content binary"))
        assert as_rows(got) == as_rows(whole) and got.count() == 15_001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_awkward_files(spark, tmp_path):
    (tmp_path / "p.xml").write_bytes(("<?xml version='1.0' encoding='windows-1251'?>" + export(3, "v8:")).encode("cp1251"))
    (tmp_path / "dtd.xml").write_text("<!DOCTYPE x [<!ENTITY e 'boom'>]>" + export(2), encoding="utf-8")
    broken = export(2) + rec("Объекты", Ref="bad", Имя="<open>") + rec("Объекты", Ref="e", Имя="&e;") + "<!--" + rec("Объекты", Ref="gone", Имя="G") + "-->"
    (tmp_path / "broken.xml").write_text(broken + "<CatalogObject.Объекты><Ref>cut", encoding="utf-8")
    (tmp_path / "other.xml").write_text("<a/>")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "deep.xml").write_text(export(1), encoding="utf-8")
    os.utime(tmp_path / "broken.xml", (1, 1))
    found = exports.exports_in(spark, str(tmp_path))
    assert {(r["rel_path"], r["encoding"], r["prefix"], r["root_name"]) for r in found.collect()} == {("p.xml", "windows-1251", "v8:", "Root"), ("broken.xml", "utf-8", "", "Root")}
    assert exports.newest_export(found) == "p.xml" and exports.newest_export(found.where("false")) is None
    read = exports.export_records(spark, str(tmp_path / "p.xml"), encoding="windows-1251", prefix="v8:")
    assert read.count() == 16 and exports.export_identity(read) == ("Conf", "1.2")
    assert {r["r"] for r in exports.export_records(spark, str(tmp_path / "broken.xml")).select(F.col("fields")["Ref"].alias("r")).where("r is not null").collect()} == {f"{a}{k}" for a in "otpq" for k in (0, 1)}
    assert exports.export_identity(read.where("false"), "R") == ("R", "0.0.0.0")


def test_snapshot_round_trip_and_builds(spark, tmp_path, capsys):
    for name, conf in (("One Export.xml", "Conf"), ("two.xml", "Other")):
        (tmp_path / name).write_text(export(8, name=conf), encoding="utf-8")
    inputs = metadata.metadata_inputs(spark, source=str(tmp_path))
    assert inputs == [("export", f"{tmp_path}/One Export.xml"), ("export", f"{tmp_path}/two.xml")]
    made = [metadata.snapshot_of_export(spark, p, str(tmp_path / "w")) for _, p in inputs]
    assert made[0].endswith("snapshots/one-export")
    manifest, objects, fields = exports.read_snapshot(spark, made[0])
    assert manifest == {"format": exports.FORMAT, "config_name": "Conf", "config_version": "1.2", "objects": 6, "fields": 18}
    read = exports.export_records(spark, inputs[0][1])
    flat = config_xml.export_fields(read).where("group <> 'values'")
    columns = ["object_id", "group", "name", "synonym", "kind", "type", "types", "tabular_section", "constant_bsl_hint"]
    assert sorted(map(repr, fields.select(columns).collect())) == sorted(map(repr, flat.select(columns).collect()))
    row = objects.where("name = 'N1'").first()
    assert row["full_name"] == "A & B" and sorted(row["attributes"]["groups"]) == ["dimensions", "tabular_section_requisites", "tabular_sections", "values"]
    both, all_objects, all_fields = exports.read_snapshots(spark, made)
    assert both["config_version"] == "multiple" and both["config_name"] == "Conf (1.2), Other (1.2)" and (all_objects.count(), all_fields.count()) == (12, 36)

    assert metadata.metadata_inputs(spark, snapshots=str(tmp_path / "w")) == [("snapshot", p) for p in made]
    assert metadata.metadata_inputs(spark, source=made[0]) == [("snapshot", made[0])]
    with pytest.raises(FileNotFoundError):
        metadata.metadata_inputs(spark, snapshots=str(tmp_path))
    with pytest.raises(FileNotFoundError):
        metadata.metadata_inputs(spark, config=str(tmp_path))
    with pytest.raises(ValueError):
        metadata.metadata_inputs(spark)
    packs.write_manifest(spark, made[1], {**exports.read_snapshot(spark, made[1])[0], "fields": 3})
    with pytest.raises(ValueError, match="manifest says"):
        exports.read_snapshot(spark, made[1])
    packs.write_manifest(spark, made[1], {"format": "other"})
    with pytest.raises(ValueError, match="no snapshot"):
        exports.read_snapshot(spark, made[1])

    (tmp_path / "w.json").write_text("{}")
    out = str(tmp_path / "out")
    assert cli.main([str(tmp_path / "w.json"), "build-metadata", "--source", str(tmp_path), "--name", "conf", "--out", out]) == 0
    assert json.loads(capsys.readouterr().out)["domain_counts"] == {"metadata_fields": 36, "metadata_objects": 12}
    assert cli.main([f"{out}/workspace/manifest", "query-kb", "--role", "metadata", "--q", "Document.N0"]) == 0
    assert '"name": "N0"' in capsys.readouterr().out
    tree = tmp_path / "tree" / "a" / "Catalogs"
    tree.mkdir(parents=True)
    (tree.parent / "Configuration.xml").write_text("<MetaDataObject><Configuration><Properties><Name>C</Name></Properties></Configuration></MetaDataObject>")
    (tree / "K.xml").write_text("<MetaDataObject><Catalog><Properties><Name>K</Name></Properties><ChildObjects><Attribute><Properties><Name>A</Name></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>")
    assert metadata.metadata_inputs(spark, config=str(tmp_path / "tree")) == [("config", str(tmp_path / "tree/a"))]
    manifest = metadata.build_metadata(spark, [("config", str(tmp_path / "tree/a"))], str(tmp_path / "out2"))
    assert manifest["domain_counts"] == {"metadata_fields": 1, "metadata_objects": 1} and manifest["config_version"] == "0.0.0.0"
