"""The side effects: looking at pairs of files, replacing duplicates by hard links, and undoing what a crash left.

Looking and replacing run in the tasks, where the files are read too; each operation is logged before anything
moves, a replacement that is run again finds its own link, and recovery can be run again at any time.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.hashing import hash_file
from .filesystem import meta

#: What is seen of a file when it is checked; the same must hold when it is replaced.
SEEN = ("size", "mtime_ns", "inode", "device")
SIDES = ("canonical", "duplicate")
LOOK = ", ".join(f"{x}_symlink boolean, {x}_now string, {', '.join(f'{x}_{c} long' for c in SEEN)}" for x in SIDES) + ", error string"


def look(pair: dict, algorithm: str) -> dict:
    """The columns of LOOK for one pair: what operators.ops.preflight judges. Contents are read only if nothing else stops the pair."""
    out: dict = dict.fromkeys((n.split()[0] for n in LOOK.split(", ")))
    try:
        for x in SIDES:
            out[f"{x}_symlink"] = os.path.islink(pair[f"{x}_path"])
        if out["canonical_symlink"] or out["duplicate_symlink"]:
            return out
        for x in SIDES:
            m = meta(pair[f"{x}_path"])
            out |= {f"{x}_{c}": m[c] for c in SEEN}
        if out["canonical_device"] == out["duplicate_device"] and out["canonical_inode"] != out["duplicate_inode"]:
            for x in SIDES:
                out[f"{x}_now"] = hash_file(pair[f"{x}_path"], algorithm)
                if out[f"{x}_now"] != pair["digest"]:
                    break
    except OSError as e:
        out["error"] = str(e)
    return out


def _each(rows: DataFrame, f, schema: str) -> DataFrame:
    """The rows with what `f` says of each (a dict), in columns of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([*rows.schema.fields, *StructType.fromDDL(schema).fields])
    kinds = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r | f(r) for r in batch.to_pylist()], schema=kinds)

    return rows.mapInArrow(run, whole)


def looked_at(pairs: DataFrame, algorithm: str) -> DataFrame:
    """The pairs with what is true of their files now, seen by the tasks; large files spread by their paths."""
    return _each(pairs.repartition(F.col("duplicate_path")), lambda p: look(p, algorithm), LOOK)


def swap(canonical: str, duplicate: str, backup: str) -> None:
    """The duplicate moves aside, a link takes its name, the backup goes; if linking fails the duplicate comes back."""
    os.rename(duplicate, backup)
    try:
        os.link(canonical, duplicate)
    except OSError:
        os.rename(backup, duplicate)
        raise
    os.remove(backup)


def replace(op: dict) -> str:
    """What a checked pair's replacement runs into: '' nothing, CHANGED_… if a file is not what was checked, EACCES, EPERM, or a text.

    `op` has the columns of LOOK and backup_path. Where the link is there already, an earlier try of this task made it.
    """
    try:
        held = {x: meta(op[f"{x}_path"]) for x in SIDES}
        same = {x: all(held[x][c] == op[f"{x}_{c}"] for c in SEEN) for x in SIDES}
        if (held["canonical"]["device"], held["canonical"]["inode"]) == (held["duplicate"]["device"], held["duplicate"]["inode"]):
            if os.path.lexists(op["backup_path"]):
                os.remove(op["backup_path"])
            return ""
        if not same["canonical"]:
            return S.SAYS_CANONICAL_CHANGED
        if not same["duplicate"]:
            return S.SAYS_DUPLICATE_CHANGED
        swap(op["canonical_path"], op["duplicate_path"], op["backup_path"])
    except OSError as e:
        return errno.errorcode[e.errno] if e.errno in (errno.EACCES, errno.EPERM) else str(e) or type(e).__name__
    return ""


def replaced(ops: DataFrame) -> DataFrame:
    """The checked pairs with `fault`, what their replacement ran into; done by the tasks."""
    return _each(ops, lambda op: {"fault": replace(op)}, "fault string")


def facts(op: dict) -> dict:
    """What exists now of a planned operation."""
    one, two, backup = op["canonical"], op["duplicate"], op["backup_path"]
    there = {"canonical_exists": os.path.exists(one), "duplicate_exists": os.path.exists(two), "backup_exists": bool(backup) and os.path.exists(backup)}
    same = there["canonical_exists"] and there["duplicate_exists"] and os.stat(one).st_ino == os.stat(two).st_ino
    return op | there | {"same_inode": bool(same)}


def recover(decided: dict) -> tuple[dict, str, str]:
    """Carries out what operators.ops.recovery decided for one operation; as replace()."""
    pair = {"canonical_path": decided["canonical"], "duplicate_path": decided["duplicate"]}
    try:
        if decided["action"] == "drop_backup":
            os.remove(decided["backup_path"])
        elif decided["action"] == "restore":
            os.rename(decided["backup_path"], decided["duplicate"])
    except OSError as e:
        return pair | {"status": S.FAILED, "message": str(e)}, S.OP_FAILED, str(e)
    return pair | {"status": decided["result"], "message": decided["result_message"]}, decided["op_status"], decided["result_message"]
