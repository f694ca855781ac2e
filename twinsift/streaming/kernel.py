"""Events of the Linux kernel about directories, as rows of (path, kind, is_dir, is_regular)."""

from __future__ import annotations

import ctypes
import errno
import os
import struct

from ..operators.events import DIR_ADDED
from ..sources.filesystem import is_plain

# The kernel's event bits that are asked for, the flags beside them, and the flags of inotify_init1.
KINDS = {0x8: "CLOSE_WRITE", 0x40: "MOVED_FROM", 0x80: "MOVED_TO", 0x100: "CREATE", 0x200: "DELETE", 0x400: "DELETE_SELF", 0x800: "MOVE_SELF"}
OVERFLOW, IGNORED, IS_DIR, ONLY_DIR, NO_FOLLOW = 0x4000, 0x8000, 0x40000000, 0x01000000, 0x02000000
NONBLOCK, CLOEXEC = 0o4000, 0o2000000
_HEAD = struct.Struct("iIII")


class Overflow(Exception):
    """The kernel dropped events: only a new listing tells what is there."""


class Watches:
    """Watches over all directories below the roots. Symbolic links are not followed; new directories are watched as they come."""

    def __init__(self, roots: list[str]) -> None:
        self.libc = ctypes.CDLL(None, use_errno=True)
        self.fd = self.libc.inotify_init1(NONBLOCK | CLOEXEC)
        if self.fd < 0:
            raise OSError(ctypes.get_errno(), "no kernel events here")
        self.dirs: dict[int, str] = {}
        for root in roots:
            self.subscribe(root)

    def close(self) -> None:
        os.close(self.fd)

    def subscribe(self, top: str) -> list[str]:
        """Watches a directory and all below it; the files that are in them. A file that comes meanwhile is listed or has its event."""
        files, waiting = [], [top]
        while waiting:
            here = waiting.pop()
            wd = self.libc.inotify_add_watch(self.fd, os.fsencode(here), sum(KINDS) | ONLY_DIR | NO_FOLLOW)
            if wd < 0:
                if ctypes.get_errno() in (errno.ENOENT, errno.ENOTDIR, errno.EACCES):
                    continue  # gone again, or not ours to see
                raise OSError(ctypes.get_errno(), f"{here} cannot be watched")
            self.dirs[wd] = here
            try:
                with os.scandir(here) as it:
                    for e in it:
                        if not e.is_symlink():
                            (waiting if e.is_dir(follow_symlinks=False) else files).append(e.path)
            except OSError:
                continue
        return files

    def unsubscribe(self, top: str) -> None:
        for wd in [w for w, d in self.dirs.items() if d == top or d.startswith(top + "/")]:
            self.libc.inotify_rm_watch(self.fd, wd)
            self.dirs.pop(wd, None)

    def read(self) -> list[tuple[str, str, bool, bool]]:
        """What has happened since the last call, in order; raises Overflow if the kernel has dropped some of it."""
        out: list[tuple[str, str, bool, bool]] = []
        while True:
            try:
                data = os.read(self.fd, 1 << 16)
            except BlockingIOError:
                return out
            at = 0
            while at < len(data):
                wd, mask, _, n = _HEAD.unpack_from(data, at)
                name = os.fsdecode(data[at + _HEAD.size : at + _HEAD.size + n].rstrip(b"\0"))
                at += _HEAD.size + n
                if mask & OVERFLOW:
                    raise Overflow
                if mask & IGNORED or wd not in self.dirs:
                    continue
                path = f"{self.dirs[wd]}/{name}" if name else self.dirs[wd]
                is_dir = bool(mask & IS_DIR) or not name
                for kind in (k for bit, k in KINDS.items() if mask & bit):
                    out.append((path, kind, is_dir, not is_dir and is_plain(path)))
                    if is_dir and name and kind in DIR_ADDED:
                        out += [(f, "CLOSE_WRITE", False, is_plain(f)) for f in self.subscribe(path)]
                    elif is_dir and (kind == "MOVED_FROM" or not name):
                        self.unsubscribe(path)
