"""One instance at a time: an advisory lock on a file of the driver's machine."""

from __future__ import annotations

import fcntl
import os


class LockFile:
    """Held until released or until the process ends; a file left behind by a crash does no harm."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.fd: int | None = None
        try:
            fd = os.open(path, os.O_CREAT | os.O_RDWR | os.O_CLOEXEC, 0o600)
        except OSError as e:
            raise RuntimeError(f"Cannot open lock file {path}: {e.strerror}") from e
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            os.close(fd)
            raise RuntimeError(f"Lock already held by another process: {path}") from None
        self.fd = fd

    def release(self) -> None:
        if self.fd is not None:
            if os.path.exists(self.path):
                os.remove(self.path)
            os.close(self.fd)
            self.fd = None

    def __enter__(self) -> LockFile:
        return self

    def __exit__(self, *_) -> None:
        self.release()
