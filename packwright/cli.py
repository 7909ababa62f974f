"""Command line: ``python -m packwright.cli WORKSPACE COMMAND ...``.

WORKSPACE is a JSON file (``{}`` at first), or OUT/workspace/manifest, which ``ensure`` and ``build-kb`` write. Commands that ask: query-kb, query-api, query-code,
query-config, resolve-packs, status, extract, verify, benchmark. Commands that build: ensure, build-kb, build-metadata,
build-standards, export, import. A bundle's own manifest serves as a workspace too.
"""

from __future__ import annotations

import argparse
import json

from packwright.plans import bundle
from packwright.plans.catalog import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="packwright")
    p.add_argument("workspace")
    sub = p.add_subparsers(dest="command", required=True)
    kb = sub.add_parser("query-kb")
    kb.add_argument("--q", required=True)
    kb.add_argument("--role", default="platform")
    kb.add_argument("--limit", type=int, default=10)
    kb.add_argument("--exact", action="store_true")
    for name, commands in (("query-code", ("stats", "modules", "symbols", "callers", "callees")), ("query-config", ("stats", "find", "read"))):
        s = sub.add_parser(name)
        s.add_argument("what", choices=commands)
        s.add_argument("--q", default="")
        s.add_argument("--limit", type=int, default=20)
    for s in (kb, sub.add_parser("resolve-packs"), sub.add_parser("status"), *[sub.choices[n] for n in ("query-code", "query-config")]):
        s.add_argument("--target")
    ensure = sub.add_parser("ensure", help="build what the sources need and write the workspace to OUT/workspace")
    ensure.add_argument("--needs", nargs="+", default=["metadata"], choices=("platform", "standards", "metadata", "code", "full"))
    ensure.add_argument("--source", nargs="+", required=True)
    book = sub.add_parser("build-kb", help="build the platform pack from VERSION=FOLDER trees of pages, unpacked books and folders of containers")
    for option in ("--tree", "--unpacked", "--books"):
        book.add_argument(option, nargs="+", default=[])
    book.add_argument("--language", default="ru")
    for option in ("--versions", "--languages"):
        book.add_argument(option, nargs="+", help="of containers; all if none is named")
    api = sub.add_parser("query-api", help="records of the platform pack by name")
    api.add_argument("what", choices=("members", "objects", "examples", "related"))
    api.add_argument("--q", required=True)
    api.add_argument("--version")
    api.add_argument("--limit", type=int, default=10)
    timed = sub.add_parser("benchmark", help="milliseconds of searches in each pack of documents")
    timed.add_argument("--loops", type=int, default=5)
    meta = sub.add_parser("build-metadata", help="build a target's metadata pack from snapshots, a configuration tree or exports, the first that is named")
    meta.add_argument("--name", required=True)
    for option in ("--snapshots", "--config", "--source"):
        meta.add_argument(option)
    rules = sub.add_parser("build-standards", help="build the standards pack of Markdown files, or read the files that changed since")
    rules.add_argument("--source", required=True)
    rules.add_argument("--version", default="1")
    copies = sub.add_parser("export", help="copy all packs under OUT")
    copies.add_argument("--archive", help="a folder for the copy's archive")
    back = sub.add_parser("import", help="unpack an archive to OUT; OUT/manifest is its workspace")
    back.add_argument("archive")
    for s in (ensure, book, meta, rules, copies, back):
        s.add_argument("--out", required=True)
    check = sub.add_parser("verify", help="ask a pack for names; ends with 1 if a check fails")
    check.add_argument("--role", default="metadata")
    check.add_argument("--name", nargs="*", default=[])
    extract = sub.add_parser("extract", help="the text of one file of a full pack")
    extract.add_argument("path")
    extract.add_argument("--to", help="a file for the bytes, which need not be text")
    for s in (check, extract):
        s.add_argument("--target")
    kb.add_argument("--domain")
    kb.add_argument("--version")
    return p


def answer(engine, a: argparse.Namespace):
    if a.command == "query-kb":
        return engine.search(a.q, a.role, target=a.target, limit=a.limit, domain=a.domain, version=a.version, exact=a.exact)
    if a.command == "query-code":
        return engine.code(a.what, a.q, a.target, a.limit)
    if a.command == "query-config":
        return engine.config(a.what, a.q, a.target, a.limit)
    if a.command == "extract":
        return engine.extract(a.path, a.to, a.target) if a.to else engine.config("read", a.path, a.target)
    if a.command == "verify":
        return engine.verify(a.role, a.name, a.target)
    if a.command == "ensure":
        return engine.ensure(a.needs, a.source, a.out)
    if a.command == "build-kb":
        return engine.build_kb([t.split("=", 1) for t in a.tree], a.language, a.out, unpacked=a.unpacked, books=a.books, versions=a.versions, languages=a.languages)
    if a.command == "query-api":
        return engine.lookup(a.what, a.q, version=a.version, limit=a.limit)
    if a.command == "benchmark":
        return engine.benchmark(a.loops)
    if a.command == "build-metadata":
        return engine.build_metadata(a.name, a.out, snapshots=a.snapshots, config=a.config, source=a.source)
    if a.command == "build-standards":
        return engine.build_standards(a.source, a.version, a.out)
    if a.command == "export":
        return engine.export(a.out, a.archive)
    if a.command == "import":
        return {"files": bundle.unpack(engine.spark, a.archive, a.out)}
    return engine.workspace.resolve_all(a.target) if a.command == "resolve-packs" else engine.status()


def plain(result) -> str:
    """Rows as JSON lines, texts as they are, other values as JSON."""
    if hasattr(result, "toJSON"):
        return "\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in result.collect())  # at most the limit asked for
    return result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, indent=2)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from packwright.api import Engine

    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    saved = json.loads("\n".join(r["value"] for r in spark.read.text(a.workspace).collect()))
    workspace = Workspace(saved.get("profile", "base"), saved.get("packs", {}), saved.get("targets", {}))
    if saved.get("format") == "packwright_bundle_v1":
        workspace = bundle.imported(spark, a.workspace.rstrip("/").removesuffix("/manifest"))
    result = answer(Engine(spark, workspace), a)
    print(plain(result))
    return int(a.command == "verify" and not result.where("not ok").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
