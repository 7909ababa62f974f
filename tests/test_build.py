import json

import pytest
from test_sources import PAGE, tree_root  # noqa: F401

from packwright import cli, rpc
from packwright.api import Engine
from packwright.plans import build, bundle, packs
from packwright.plans.catalog import Workspace
from packwright.sources import files


def test_target_ensure_and_export(spark, tree_root, tmp_path):  # noqa: F811
    source = tree_root
    w = Workspace()
    assert build.ensure(spark, w, ["full"], {"c": source}, str(tmp_path / "w")) == ["conf_1.2"] and w.profile == "full"
    assert build.ensure(spark, w, ["code"], {"c": source}, str(tmp_path / "w")) == []
    full = packs.read_manifest(spark, w.resolve("full"))
    assert full["excluded"] == {"image-asset": 1} and full["rows"]["blobs"] == 10
    docs = packs.table(spark, w.resolve("metadata"), "docs")
    assert docs.where("topic_path = 'Document.D1.T1.B1'").count() == 1
    made = bundle.export(spark, w, str(tmp_path / "bundle"))
    assert made["targets"]["conf_1.2"]["packs"]["code"] == "conf_1.2/code"
    assert packs.table(spark, str(tmp_path / "bundle/conf_1.2/code"), "symbols").count() == 4


def test_help_pack_merges_versions(spark, tmp_path):
    for v in ("8.3.9", "8.3.10"):
        folder = tmp_path / v / "o" / "methods"
        folder.mkdir(parents=True)
        (folder / "get.html").write_text(PAGE, encoding="utf-8")
    trees = [(files.scan(spark, str(tmp_path / v)), v, "ru") for v in ("8.3.9", "8.3.10")]
    manifest = build.build_help(trees, str(tmp_path / "p"))
    assert manifest["domain_counts"] == {"api_examples": 1, "api_links": 4, "api_members": 1} and manifest["versions_seen"] == ["8.3.10", "8.3.9"]
    row = packs.table(spark, str(tmp_path / "p"), "docs").where("domain = 'api_members'").first()
    assert row["name"] == "Получить" and "Gets it." in row["payload"]
    assert spark.read.parquet(str(tmp_path / "p/links")).where("link_kind = 'see_also'").count() == 2


def test_commands_build_verify_extract_and_export(spark, tree_root, tmp_path, capsys):  # noqa: F811
    out, pages = str(tmp_path / "w"), tmp_path / "help" / "o" / "methods"
    pages.mkdir(parents=True)
    (pages / "get.html").write_text(PAGE, encoding="utf-8")
    (tmp_path / "w.json").write_text("{}")
    assert cli.main([str(tmp_path / "w.json"), "build-kb", "--tree", f"8.3.10={tmp_path / 'help'}", "--out", out]) == 0
    saved = f"{out}/workspace/manifest"
    assert cli.main([saved, "ensure", "--needs", "full", "--source", tree_root, "--out", out]) == 0
    capsys.readouterr()
    assert cli.main([saved, "verify", "--name", "Document.D1"]) == 0 and '"ok": true' in capsys.readouterr().out
    assert cli.main([saved, "verify", "--name", "Document.Missing"]) == 1
    capsys.readouterr()
    assert cli.main([saved, "extract", "Configuration.xml"]) == 0 and "<Name>Conf</Name>" in capsys.readouterr().out
    assert cli.main([saved, "query-kb", "--q", "Получить"]) == 0 and "Получить" in capsys.readouterr().out
    asked = [("platform", "gets it"), ("platform", "Получить"), ("metadata", "d1 док"), ("metadata", "Document.D1")]
    found = lambda engine: [[tuple(r) for r in engine.search(q, role).collect()] for role, q in asked]
    w = json.loads(spark.read.text(saved).first()["value"])
    before = found(Engine(spark, Workspace(w["profile"], w["packs"], w["targets"])))
    assert all(before)
    assert cli.main([saved, "export", "--out", str(tmp_path / "bundle"), "--archive", str(tmp_path / "zip")]) == 0
    assert packs.read_manifest(spark, str(tmp_path / "bundle"))["packs"] == {"platform": "platform"}
    assert spark.read.parquet(str(tmp_path / "bundle/platform/links")).count() == spark.read.parquet(f"{out}/platform/links").count()
    assert found(Engine(spark, bundle.imported(spark, str(tmp_path / "bundle")))) == before
    # The same folder gives the same bytes, in one part or many; unpacked, it answers the same.
    one = (tmp_path / "zip/part-00000.zip").read_bytes()
    bundle.archive(spark, str(tmp_path / "bundle"), str(tmp_path / "again"))
    assert (tmp_path / "again/part-00000.zip").read_bytes() == one
    assert bundle.archive(spark, str(tmp_path / "bundle"), str(tmp_path / "many"), part_bytes=20_000)["parts"] > 2
    for name in ("zip", "many"):
        assert cli.main([str(tmp_path / "w.json"), "import", str(tmp_path / name), "--out", str(tmp_path / f"{name}-out")]) == 0
        assert found(Engine(spark, bundle.imported(spark, str(tmp_path / f"{name}-out")))) == before
    capsys.readouterr()
    assert cli.main([str(tmp_path / "zip-out/manifest"), "query-kb", "--q", "Получить"]) == 0 and "Получить" in capsys.readouterr().out
    (tmp_path / "again/part-00000.zip").write_bytes(one.replace(b"Conf", b"Cont"))
    with pytest.raises(Exception, match="altered|CRC"):
        bundle.unpack(spark, str(tmp_path / "again"), str(tmp_path / "bad"))


def test_ensure_tool(spark, tree_root, tmp_path):  # noqa: F811
    engine = Engine(spark, Workspace())
    asked = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "ensure", "arguments": {"needs": ["metadata"], "sources": [tree_root], "out": str(tmp_path)}}}
    result = rpc.handle(engine, json.dumps(asked))["result"]
    assert not result["isError"] and json.loads(result["content"][0]["text"]) == {"built": ["conf_1.2"], "profile": "metadata"}
