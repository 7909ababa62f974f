"""Workspaces: which packs serve which target, whether they are stale, and what to build."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What each profile builds, from the least to the most.
PROFILES = {"base": ("platform",), "metadata": ("platform", "metadata"), "dev": ("platform", "metadata", "code"), "full": ("platform", "metadata", "code", "full")}
ROLES = ("platform", "standards", "metadata", "code", "full")


def profile_for(current: str, needs: list[str]) -> str:
    """The least profile, no lower than the current one, that has all that is needed."""
    order = list(PROFILES)
    return next(p for p in order[order.index(current) :] if set(needs) - {"standards"} <= set(PROFILES[p]))


def public(value, key: str | None = None):
    """A manifest without absolute paths: each becomes the last part of itself."""
    if isinstance(value, dict):
        return {k: public(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [public(v, key) for v in value]
    if isinstance(value, str) and re.match(r"^(?:/|~|[A-Za-z]:[\\/]|[a-z]+://)", value):
        return re.split(r"[\\/]", value.rstrip("\\/"))[-1]
    return value


def target_names(spark: SparkSession, configs: DataFrame) -> DataFrame:
    """configs with a name for each, stem of name and version, numbered where stems meet."""
    from pyspark.sql import Window

    from packwright.functions.text import slug

    stem = F.concat_ws("_", slug("config_name"), slug("config_version"))
    n = F.row_number().over(Window.partitionBy("_stem").orderBy("config_root"))
    named = configs.withColumn("_stem", stem).withColumn("_n", n)
    return named.withColumn("target", F.when(F.col("_n") > 1, F.concat_ws("_", "_stem", "_n")).otherwise(F.col("_stem"))).drop("_stem", "_n")


@dataclass
class Workspace:
    """Shared packs by role, and targets with packs of their own and the source they were built from."""

    profile: str = "base"
    packs: dict[str, str] = field(default_factory=dict)
    targets: dict[str, dict] = field(default_factory=dict)

    def resolve(self, role: str, target: str | None = None) -> str:
        """The pack of a role; a target must be named where several could be meant."""
        if role not in ROLES:
            raise KeyError(f"unknown role: {role}")
        if role in ("platform", "standards"):
            found = [self.packs[role]] if role in self.packs else []
        elif target:
            found = [p for p in [self.targets.get(target, {}).get("packs", {}).get(role)] if p]
        else:
            found = [t["packs"][role] for t in self.targets.values() if role in t.get("packs", {})]
        if len(found) != 1:
            raise LookupError(f"{len(found)} packs for role {role}" + (f" of {target}" if target else "; name a target" if len(found) > 1 else ""))
        return found[0]

    def resolve_all(self, target: str | None = None) -> dict[str, str]:
        out = {}
        for role in ROLES:
            try:
                out[role] = self.resolve(role, target)
            except LookupError:
                continue
        return out

    def satisfies(self, needs: list[str]) -> bool:
        return all(r in self.packs if r in ("platform", "standards") else self.targets and all(r in t.get("packs", {}) for t in self.targets.values()) for r in needs)

    def issues(self, sources: dict[str, dict], versions_seen: list[str], wanted_versions: list[str]) -> list[tuple[str, str]]:
        """(where, what): targets whose source has changed or gone, targets without packs, versions that aren't there."""
        found = [("platform", f"missing version {v}") for v in sorted(set(wanted_versions) - set(versions_seen))]
        for name, t in self.targets.items():
            now = sources.get(name)
            if now is None:
                found.append((name, "missing source"))
            elif now != t.get("source"):
                found.append((name, "stale"))
            found += [(name, f"missing {r}") for r in PROFILES[self.profile][1:] if r not in t.get("packs", {})]
            if t.get("kind") == "extension" and not any(o.get("kind") != "extension" for o in self.targets.values()):
                found.append((name, "extension without base"))
        return found

    def as_dict(self) -> dict:
        return {"format": "packwright_workspace_v1", "profile": self.profile, "packs": self.packs, "targets": self.targets}


def source_snapshot(files: DataFrame) -> dict:
    """What a source looks like now: files, bytes and a digest over names, sizes and times, from one aggregate."""
    one = F.xxhash64("rel_path", "length", F.col("modified").cast("string"))
    row = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0)).alias("d")).first()
    return {"files": row["files"], "bytes": row["bytes"], "digest": str(row["d"])}


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, digest) isn't known: all that an incremental build has to read."""
    return now.join(known.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_anti")


def verify(docs: DataFrame, names: list[str]) -> DataFrame:
    """(check, ok): every name answers, no field is blank, forms are there."""
    from packwright.functions.text import fold, strip

    row = docs.agg(
        *[F.count_if((fold("name") == n.lower()) | (fold("topic_path") == n.lower())).alias(f"answers {n}") for n in names],
        F.count_if((F.col("domain") == "metadata_fields") & (strip("name") == "")).alias("blank"), F.count_if(F.contains("topic_path", F.lit(".Forms."))).alias("forms"),
    ).first()
    checks = [(f"answers {n}", row[f"answers {n}"] > 0) for n in names] + [("no blank fields", row["blank"] == 0), ("has forms", row["forms"] > 0)]
    return docs.sparkSession.createDataFrame(checks, "check string, ok boolean")
