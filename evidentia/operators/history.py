"""Entity timelines, code and document history, project ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import SECTION_SCHEMA, entity_key, section_rows
from evidentia.sources.scratch import kept


def entity_catalogue(rows: DataFrame) -> DataFrame:
    """Of rows(entity, memory_id, effective_at): label, number of memories and last time of each entity."""
    return rows.groupBy(entity_key(F.col("entity")).alias("entity_key")).agg(F.min("entity").alias("label"), F.count(F.lit(1)).alias("memories"), F.max("effective_at").alias("last_at"))


def entity_timeline(rows: DataFrame, memories: DataFrame, phrase: str, limit: int | None = None) -> DataFrame:
    """The memories of entities whose key is or contains the phrase, oldest first, flagged if superseded."""
    key = " ".join(phrase.lower().split())
    hit = rows.withColumn("entity_key", entity_key(F.col("entity"))).filter((F.col("entity_key") == key) | F.col("entity_key").contains(key))
    gone = memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id"), F.lit(True).alias("_gone")).distinct()
    out = hit.join(memories, "memory_id").join(gone, "memory_id", "left").withColumn("superseded", F.coalesce("_gone", F.lit(False))).drop("_gone")
    return out if limit is None else out.orderBy("effective_at", "memory_id", "entity_key").limit(limit)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of two snapshots(path, sha256): ADDED, MODIFIED or DELETED."""
    both = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "DELETED").when(F.col("old") != F.col("new"), "MODIFIED")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("path", "change", F.col("old").alias("before_sha"), F.col("new").alias("after_sha"))


def false_deletions(changes: DataFrame, present: DataFrame) -> DataFrame:
    """Of changes(change_id, project_id, file_path, change_kind, revision): deletions that nothing followed, of files that are present(project_id, file_path).

    They came from a scan that left the files out; a file deleted and made again has a later change.
    """
    last = F.max("revision").over(Window.partitionBy("project_id", "file_path"))
    gone = changes.withColumn("_last", last).filter("revision = _last AND change_kind = 'DELETED'").drop("_last")
    return gone.join(present.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi")


def repaired(changes: DataFrame, present: DataFrame, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """changes, and symbols(change_id, ...), without false deletions."""
    wrong = kept(false_deletions(changes, present).select("change_id"))
    return changes.join(wrong, "change_id", "left_anti"), None if symbols is None else symbols.join(wrong, "change_id", "left_anti")


def newest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each file by revision."""
    last = F.max("revision").over(Window.partitionBy("project_id", "file_path"))
    return changes.withColumn("_last", last).filter("revision = _last").drop("_last")


def code_activity(changes: DataFrame, *, path: str | None = None, kind: str | None = None, project: str | None = None, since=None, until=None, symbol: str | None = None, symbols: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """Changes newest first; path matches whole or as a suffix below a folder."""
    if path is not None:
        changes = changes.filter((F.col("file_path") == path) | F.col("file_path").endswith("/" + path))
    if kind is not None:
        changes = changes.filter(F.col("change_kind") == kind)
    if project is not None:
        changes = changes.filter(F.col("project_id") == project)
    if since is not None:
        changes = changes.filter(F.col("happened_at") >= since)
    if until is not None:
        changes = changes.filter(F.col("happened_at") <= until)
    if symbol is not None:
        changes = changes.join(symbols.filter(F.col("symbol_name").contains(symbol)), "change_id", "left_semi")
    return changes if limit is None else changes.orderBy(F.desc("happened_at"), F.desc("revision")).limit(limit)


def document_sections(documents: DataFrame) -> DataFrame:
    """turn_id, section, heading, body of documents(turn_id, content)."""
    return documents.select("turn_id", "content").mapInPandas(section_rows, SECTION_SCHEMA)


def replaced_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections(path, body_sha) that the file's new version no longer has."""
    return old.join(new, ["path", "body_sha"], "left_anti").join(new.select("path").distinct(), "path", "left_semi")


def ledger_timeline(checkpoints: DataFrame, *, limit: int | None = None, per: str = "project") -> DataFrame:
    """Published checkpoints of each project, newest first; retracted ones leave before the limit.

    A checkpoint is superseded only if the one that supersedes it is published.
    """
    shown = checkpoints.filter("status = 'published'")
    by = shown.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("checkpoint_id"), F.lit(True).alias("_by")).distinct()
    out = shown.join(by, "checkpoint_id", "left").withColumn("superseded", F.coalesce("_by", F.lit(False))).drop("_by")
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("stamp"), F.desc("checkpoint_id")))
    out = out.withColumn("place", place)
    return out if limit is None else out.filter(F.col("place") <= limit)


def ledger_projects(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("project").agg(F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") == "retracted").alias("retracted"), F.max(F.when(F.col("status") == "published", F.col("stamp"))).alias("last_published"))


def ledger_audit(audit: DataFrame, accounts: DataFrame) -> DataFrame:
    """Audit rows with the account's name, or the id where no account is left."""
    return audit.join(accounts, "member", "left").withColumn("who", F.coalesce("name", F.col("member").cast("string")))


ROLES = ["viewer", "editor", "owner"]


def accessible(rows: DataFrame, access: DataFrame, member, role: str = "viewer") -> DataFrame:
    """Rows of the projects in which the member has the role or a higher one."""
    allowed = access.filter((F.col("member") == member) & F.col("role").isin(ROLES[ROLES.index(role) :]))
    return rows.join(allowed, "project", "left_semi")


def sole_owned(access: DataFrame, member) -> DataFrame:
    """Projects whose only owner is the member: their owner can't leave before another is named."""
    owners = access.filter("role = 'owner'")
    return owners.filter(F.col("member") == member).select("project").join(owners.filter(F.col("member") != member), "project", "left_anti")


def bind_projects(folders: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each folder(cwd) with the binding(root, project) of the longest root above it.

    A folder's own ancestors are joined to roots by equality, so no folder meets an unrelated root.
    """
    parts = F.split("cwd", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = folders.select("cwd", F.explode(above).alias("root")).join(bindings, "root")
    return hit.groupBy("cwd").agg(F.max_by("project", F.length("root")).alias("project"))
