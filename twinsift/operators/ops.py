"""Replacing duplicates by links: checks before, a log of operations, results, and recovery after a crash.

The log is append-only: each row is a state of an operation, and the last one by seq is its current state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codecs import op_status
from .index import latest


def append_planned(pairs: DataFrame, first_id: int, backup: Column, now: int) -> DataFrame:
    """Planned operations for pairs that have a number n (from 0): ids go up from `first_id`."""
    return pairs.select(
        (F.col("n") + first_id).cast("long").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("canonical_path").alias("canonical"), F.col("duplicate_path").alias("duplicate"),
        backup.alias("backup_path"), F.lit(S.OP_PLANNED).alias("status"), F.lit("").alias("message"), F.lit(now).cast("long").alias("created_at"),
    )


def current(log: DataFrame) -> DataFrame:
    """The current state of each operation; the last write wins, whatever it was. Unknown status text is planned."""
    return latest(log, "id", "seq").withColumn("status", op_status(F.col("status")))


def by_status(log: DataFrame, status: str) -> DataFrame:
    return current(log).where(F.col("status") == status).orderBy("id")


def preflight(pairs: DataFrame) -> DataFrame:
    """Whether each pair can be linked now: status (null: go ahead) and message, by the first check that stops it.

    Pairs carry what is true at this moment: canonical_symlink, duplicate_symlink, canonical_device,
    duplicate_device, canonical_inode, duplicate_inode, canonical_now, duplicate_now (digests); what was not looked at,
    since an earlier check stops the pair, is null. A column `error`, if there is one, is what looking ran into.
    """
    checks = (
        (F.col("canonical_symlink") | F.col("duplicate_symlink"), S.SKIPPED, S.SAYS_SYMLINK),
        (F.col("canonical_device") != F.col("duplicate_device"), S.SKIPPED, S.SAYS_CROSS_DEVICE),
        (F.col("canonical_inode") == F.col("duplicate_inode"), S.ALREADY_LINKED, ""),
        (F.col("canonical_now") != F.col("digest"), S.SKIPPED, S.SAYS_CANONICAL_CHANGED),
        (F.col("duplicate_now") != F.col("digest"), S.SKIPPED, S.SAYS_DUPLICATE_CHANGED),
    )
    status, message = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    if "error" in pairs.columns:
        status, message = status.when(F.col("error").isNotNull(), F.lit(S.FAILED)), message.when(F.col("error").isNotNull(), F.col("error"))
    for stops, said, why in checks:
        status, message = status.when(stops, F.lit(said)), message.when(stops, F.lit(why))
    return pairs.select("*", status.alias("status"), F.coalesce(message, F.lit("")).alias("message"))


def results(checked: DataFrame) -> DataFrame:
    """Results of an apply from checked pairs and `fault`, what the replacement ran into ('' nothing, 'EACCES', 'EPERM', or a text).

    A path that cannot be written, or a file that has changed since it was checked, is skipped, though the operation
    counts as failed in the log.
    """
    go, fault = F.col("status").isNull(), F.col("fault")
    unwritable = fault.isin("EACCES", "EPERM")
    late = fault.isin(S.SAYS_CANONICAL_CHANGED, S.SAYS_DUPLICATE_CHANGED)
    status = F.when(~go, F.col("status")).when(fault == "", S.LINKED).when(unwritable | late, S.SKIPPED).otherwise(S.FAILED)
    message = F.when(~go, F.col("message")).when(fault == "", "").when(unwritable, S.SAYS_NOT_WRITABLE).otherwise(fault)
    op = F.when(go, F.when(fault == "", S.OP_DONE).otherwise(S.OP_FAILED))
    return checked.select(*S.DUPE_PAIR, status.alias("status"), message.alias("message"), op.alias("op_status"))


def ended(planned: DataFrame, replaced: DataFrame) -> DataFrame:
    """The log's last states of planned operations (with id, seq and so on) from the results of their pairs."""
    result = results(replaced).select("duplicate_path", "op_status", F.col("message").alias("said"))
    met = planned.join(result, planned["duplicate"] == result["duplicate_path"])
    return met.select("id", (F.col("seq") + 1).alias("seq"), "canonical", "duplicate", "backup_path", F.col("op_status").alias("status"), F.col("said").alias("message"), "created_at")


def recovery(planned: DataFrame) -> DataFrame:
    """What becomes of each planned operation, from what exists now: canonical_exists, duplicate_exists, backup_exists, same_inode.

    Columns added: action (drop_backup, restore, none), status (of the result), op_status and message. A backup
    that was never recorded counts as missing; devices are not compared.
    """
    backup = F.col("backup_exists") & (F.col("backup_path") != "")
    linked = F.col("canonical_exists") & F.col("duplicate_exists") & F.col("same_inode")
    restore = backup & ~F.col("duplicate_exists")
    return planned.select(
        "*",
        F.when(linked, F.when(backup, "drop_backup").otherwise("none")).when(restore, "restore").otherwise("none").alias("action"),
        F.when(linked, S.LINKED).otherwise(S.FAILED).alias("result"),
        F.when(linked, S.OP_DONE).otherwise(S.OP_FAILED).alias("op_status"),
        F.when(linked, "").when(restore, S.SAYS_RESTORED).otherwise(S.SAYS_UNRECOVERABLE).alias("result_message"),
    )
