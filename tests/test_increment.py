"""Packs that follow their source."""

import json
import os

from pyspark.sql import functions as F

from packwright import cli
from packwright.operators import fts
from packwright.plans import increment, packs
from packwright.sources import markdown


def shown(spark, path):
    """What a pack answers: its rows, and scores of a few queries from its index."""
    manifest = packs.read_manifest(spark, path)
    live = lambda n: increment.live(spark, path, n, manifest)
    rows = sorted(tuple(r) for r in live("docs").select("name", "topic_path", "payload").collect())
    scores = {q: sorted((r["doc_id"], round(r["score"], 9)) for r in fts.bm25_indexed(live("postings"), live("lengths"), q, manifest["text_index"]).collect()) for q in ("common", "word3", "fresh common", "old_text")}
    return rows, scores, manifest["text_index"], manifest["domain_counts"]


def test_update_reads_changed_files_only(spark, tmp_path):
    source, pack = tmp_path / "s", str(tmp_path / "p")
    source.mkdir()
    put = lambda name, text, at: ((source / name).write_text(f"# {name}\n\n{text}"), os.utime(source / name, (at, at)))
    for k in range(8):
        put(f"f{k}.md", f"common word{k} old text", 100)
    read = []

    def make(files):
        read.append(sorted(r["rel_path"] for r in files.collect()))
        return markdown.standards(files, "1")

    first = increment.build(spark, str(source), "*.md", make, pack)
    assert first["files_read"] == 8 and len(read[-1]) == 8
    put("f3.md", "common fresh", 200)
    put("new.md", "fresh common", 200)
    (source / "f5.md").unlink()
    second = increment.update(spark, str(source), "*.md", make, pack)
    assert read[-1] == ["f3.md", "new.md"] and second["files_read"] == 2 and len(second["generations"]) == 2
    put("f3.md", "common word3 old text", 300)  # as it was: rows that died may come back
    assert increment.update(spark, str(source), "*.md", make, pack)["files_read"] == 1
    assert increment.update(spark, str(source), "*.md", make, pack)["files_read"] == 0 and len(read) == 3
    full = str(tmp_path / "full")
    increment.build(spark, str(source), "*.md", make, full)
    assert shown(spark, pack) == shown(spark, full)
    increment.compacted(spark, pack, str(tmp_path / "c"))
    assert shown(spark, str(tmp_path / "c")) == shown(spark, full) and packs.table(spark, str(tmp_path / "c"), "docs").count() == 8
    # Rows of an update that never got to its manifest aren't seen.
    packs.table(spark, pack, "docs").limit(1).withColumn("generation", F.lit(5).cast("long")).write.mode("append").partitionBy("domain").parquet(f"{pack}/docs")
    assert shown(spark, pack) == shown(spark, full)


def test_standards_command(spark, tmp_path, capsys):
    source, out = tmp_path / "s", str(tmp_path / "o")
    source.mkdir()
    (source / "a.md").write_text("# One\n\nfirst rule")
    (tmp_path / "w.json").write_text("{}")
    assert cli.main([str(tmp_path / "w.json"), "build-standards", "--source", str(source), "--out", out]) == 0
    (source / "b.md").write_text("# Two\n\nsecond rule")
    capsys.readouterr()
    saved = f"{out}/workspace/manifest"
    assert cli.main([saved, "build-standards", "--source", str(source), "--out", out]) == 0
    assert json.loads(capsys.readouterr().out)["files_read"] == 1
    assert cli.main([saved, "query-kb", "--role", "standards", "--q", "second rule"]) == 0 and '"name": "Two"' in capsys.readouterr().out
    assert cli.main([saved, "query-kb", "--role", "standards", "--q", "one"]) == 0 and '"name": "One"' in capsys.readouterr().out
