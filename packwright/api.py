"""The engine: packs opened by role, searched cheapest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import resolver
from packwright.functions.text import fold
from packwright.operators import code, fts, lookup, stats, vectors
from packwright.plans import benchmark, build, bundle, increment, metadata, packs, platform
from packwright.plans.catalog import Workspace, public, verify
from packwright.sources import files, help_topics, markdown
from packwright.sources.listing import opened

#: Best rows of text and of vectors that a blend looks at.
BLENDED = 100
SHOWN = ("domain", "name", "topic_path", "version", "snippet")


class Engine:
    def __init__(self, spark: SparkSession, workspace: Workspace):
        self.spark, self.workspace = spark, workspace

    def _table(self, role: str, name: str, target: str | None) -> DataFrame:
        return increment.live(self.spark, self.workspace.resolve(role, target), name)

    def search(self, q: str, role: str = "platform", *, target: str | None = None, limit: int = 10, domain: str | None = None, version: str | None = None, exact: bool = False, vector: list[float] | None = None) -> DataFrame:
        """Pack rows equal to the query by name or path; if there are none (and not ``exact``), full-text matches.

        With a ``vector``, in a pack that has some, matches of text and neighbours by cosine are fused by their ranks.
        """
        docs = self._table(role, "docs", target)
        docs = docs.where(F.col("domain") == domain) if domain else docs
        docs = docs.where(lookup.applies_to(F.col("version"), F.col("versions"), version))
        shown = lambda df: df.withColumn("snippet", F.substring("payload", 1, 200)).select(*SHOWN)
        key = fold(F.lit(q))
        equal = docs.where((F.col("name_key") == key) | (F.col("path_key") == key))
        if exact or not equal.isEmpty():
            return shown(equal.orderBy("doc_id").limit(limit))
        scored = self._scored(docs, q, role, target)
        if vector is not None:
            own = self._table(role, "vectors", target).join(docs.select("doc_id"), "doc_id", "left_semi")
            near = vectors.cosine_topk(own, vector, id_col="doc_id", vector_col="vector", k=BLENDED)
            text = vectors.placed(scored.join(docs.select("doc_id"), "doc_id", "left_semi"), "doc_id", "score", BLENDED)
            fused = vectors.blended(text, vectors.placed(near, "doc_id", -F.col("cosine"), BLENDED), "doc_id")
            scored = fused.select("doc_id", (-F.col("score")).alias("score"))
        return shown(docs.join(scored, "doc_id").orderBy("score", F.length("name"), "doc_id").limit(limit))

    def _scored(self, docs: DataFrame, q: str, role: str, target: str | None) -> DataFrame:
        """Scores from the pack's text index; packs without one are scanned."""
        totals = packs.read_manifest(self.spark, self.workspace.resolve(role, target)).get("text_index")
        if not totals:
            return fts.bm25(docs, "doc_id", packs.INDEXED, q)
        return fts.bm25_indexed(self._table(role, "postings", target), self._table(role, "lengths", target), q, totals)

    def lookup(self, what: str, q: str, *, version: str | None = None, limit: int = 10) -> DataFrame:
        """Records of the platform pack that are called like the query: members, objects, examples (by score) or related names."""
        rows = self._table("platform", {"related": "links"}.get(what, what), None)
        if what == "members":
            return lookup.exact_members(rows, q, version, limit)
        if what == "objects":
            return lookup.exact_objects(rows, q, version, limit)
        if what == "examples":
            return lookup.ranked_examples(rows.where(lookup.applies_to(F.col("version"), F.col("versions"), version)), q, limit)
        if what == "related":
            return lookup.equal_rows(rows, q, ["source_full_name"]).orderBy("link_kind", "target_name").limit(limit)
        raise KeyError(f"unknown records: {what}")

    def benchmark(self, loops: int = 5) -> DataFrame:
        """Milliseconds that searches of fixed names take in each pack of documents: average, 95th percentile and runs."""
        return benchmark.search_times(self, loops)

    def candidates(self, q: str) -> DataFrame:
        return resolver.resolved(self.spark.createDataFrame([(q,)], "query string"), "query")

    def code(self, command: str, q: str = "", target: str | None = None, limit: int = 20) -> DataFrame:
        t = lambda n: self._table("code", n, target)
        if command == "stats":
            return stats.counter(t("symbols"), "kind").unionByName(stats.counter(t("modules"), F.col("module_kind").alias("kind")))
        if command == "modules":
            return code.modules(t("modules"), q, limit)
        if command == "symbols":
            return code.symbols(t("symbols").withColumn("symbol_id", F.xxhash64("module_id", "name", "line")), t("modules"), q, limit)
        if command == "callers":
            return code.callers(t("calls"), t("modules"), q, limit)
        if command == "callees":
            return code.callees(t("calls"), q, limit)
        raise KeyError(f"unknown code command: {command}")

    def config(self, command: str, q: str = "", target: str | None = None, limit: int = 20) -> DataFrame | str:
        entries, blobs = self._table("full", "entries", target), self._table("full", "blobs", target)
        if command == "stats":
            return packs.config_stats(entries, blobs)
        if command == "find":
            return lookup.find(entries, q, path_col="rel_path", name_col="object_name", columns=["rel_path", "object_type", "object_name", "text_excerpt"], limit=limit)
        if command == "read":
            return files.text_of(entries, blobs, q)
        raise KeyError(f"unknown config command: {command}")

    def extract(self, path: str, to: str, target: str | None = None) -> dict:
        """Writes one file of a full pack, binary ones as well, to a place in any store that pyarrow opens."""
        content = files.bytes_of(self._table("full", "blobs", target), path)
        store, place = opened(to)
        with store.open_output_stream(place) as f:
            f.write(content)
        return {"path": path, "bytes": len(content)}

    def status(self) -> dict:
        return public(self.workspace.as_dict())

    def verify(self, role: str = "metadata", names: list[str] | None = None, target: str | None = None) -> DataFrame:
        """(check, ok) for a docs pack: each name answers, no field is blank, forms are there."""
        return verify(self._table(role, "docs", target), names or [])

    def ensure(self, needs: list[str], sources: list[str], out: str) -> dict:
        """Builds what is missing or stale of the sources' targets; the workspace is kept in OUT/workspace."""
        built = build.ensure(self.spark, self.workspace, needs, {s: s for s in sources}, out)
        packs.write_manifest(self.spark, f"{out}/workspace", self.workspace.as_dict())
        return {"built": built, "profile": self.workspace.profile}

    def build_kb(self, trees: list[tuple[str, str]], language: str, out: str, *, unpacked: tuple[str, ...] = (), books: tuple[str, ...] = (), versions: list[str] | None = None, languages: list[str] | None = None) -> dict:
        """Builds the platform pack of (version, folder) trees of pages, unpacked books and folders of containers; the workspace is kept in OUT/workspace."""
        read = [help_topics.of_tree(files.scan(self.spark, folder), version, language) for version, folder in trees]
        read += [help_topics.of_unpacked(files.scan(self.spark, folder)) for folder in unpacked]
        read += [help_topics.of_books(self.spark, folder, versions, languages) for folder in books]
        if not read:
            raise ValueError("name a tree, an unpacked folder or a folder of containers")
        manifest = platform.build_platform(read, f"{out}/platform")
        self.workspace.packs["platform"] = f"{out}/platform"
        packs.write_manifest(self.spark, f"{out}/workspace", self.workspace.as_dict())
        return public(manifest)

    def build_metadata(self, name: str, out: str, **sources: str | None) -> dict:
        """Builds a target's metadata pack from snapshots, a configuration tree or exports; the workspace is kept in OUT/workspace."""
        manifest = metadata.build_metadata(self.spark, metadata.metadata_inputs(self.spark, **sources), f"{out}/{name}")
        self.workspace.targets.setdefault(name, {"kind": "configuration", "packs": {}})["packs"]["metadata"] = f"{out}/{name}/metadata"
        packs.write_manifest(self.spark, f"{out}/workspace", self.workspace.as_dict())
        return public(manifest)

    def build_standards(self, source: str, version: str, out: str) -> dict:
        """Builds the standards pack of a folder of Markdown files or, where OUT has one, brings it up to the folder."""
        make, path = lambda files: markdown.standards(files, version), f"{out}/standards"
        known = self.workspace.packs.get("standards") == path
        manifest = (increment.update if known else increment.build)(self.spark, source, "*.md", make, path)
        self.workspace.packs["standards"] = path
        packs.write_manifest(self.spark, f"{out}/workspace", self.workspace.as_dict())
        return public(manifest)

    def export(self, out: str, archive: str | None = None) -> dict:
        """Copies all packs under OUT and, if asked, archives the copy in another folder."""
        manifest = bundle.export(self.spark, self.workspace, out)
        if archive:
            manifest = manifest | {"archive": bundle.archive(self.spark, out, archive)}
        return public(manifest)
