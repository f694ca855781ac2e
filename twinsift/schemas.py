"""Record types as Spark schemas, and the literals that results carry."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG = T.LongType()

META = ("size", "mtime_ns", "inode", "device", "mode", "uid", "gid")
FILE_META = T.StructType([T.StructField(c, _LONG) for c in META])

#: One path of a scan: bag semantics, an overlapping root lists it twice.
SCANNED_FILE = T.StructType([T.StructField("root", T.StringType()), T.StructField("path", T.StringType()), T.StructField("is_regular", T.BooleanType()), *FILE_META.fields, T.StructField("error", T.StringType())])

PATHS = T.StructType([T.StructField("path", T.StringType()), T.StructField("device", _LONG), T.StructField("inode", _LONG), T.StructField("last_seen", _LONG)])
INODES = T.StructType([*(T.StructField(c, _LONG) for c in ("device", "inode", "size", "mtime_ns", "mode", "uid", "gid")), T.StructField("digest", T.StringType()), T.StructField("last_seen", _LONG)])
OP_EVENTS = T.StructType([
    T.StructField("id", _LONG), T.StructField("seq", _LONG), T.StructField("canonical", T.StringType()), T.StructField("duplicate", T.StringType()),
    T.StructField("backup_path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("created_at", _LONG),
])
WATCH_EVENT = T.StructType([T.StructField("seq", _LONG), T.StructField("path", T.StringType()), T.StructField("type", T.StringType())])
RAW_EVENT = T.StructType([T.StructField("seq", _LONG), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("is_dir", T.BooleanType()), T.StructField("is_regular", T.BooleanType())])
DUPE_PAIR = ("canonical_path", "duplicate_path", "digest", "size_bytes")

# Statuses and messages of results.
LINKED, ALREADY_LINKED, SKIPPED, FAILED = "Linked", "AlreadyLinked", "Skipped", "Failed"
OP_PLANNED, OP_DONE, OP_FAILED = "planned", "done", "failed"
HIT, MISS = "Hit", "Miss"
MODIFIED, DELETED = "Modified", "Deleted"
SAYS_DRY_RUN = "dry-run"
SAYS_SYMLINK = "symlink detected, skipped"
SAYS_CROSS_DEVICE = "cross-device, cannot hardlink"
SAYS_CANONICAL_CHANGED = "canonical file changed between scan and apply, skipped"
SAYS_DUPLICATE_CHANGED = "file changed between scan and apply, skipped"
SAYS_NOT_WRITABLE = "duplicate path not writable, skipped"
SAYS_RESTORED = "recovered original after interrupted apply"
SAYS_UNRECOVERABLE = "interrupted apply could not be automatically recovered"
