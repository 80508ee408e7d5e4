"""Writing a journal next to the snapshots it describes, on one machine's file system.

An intent is on disk before a change is published and its acknowledgement after.  One writer at a time holds the
lock; another that finds it taken does nothing.
"""

from __future__ import annotations

import contextlib
import fcntl
import gzip
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

#: Size at which the journal is put away, and how many are kept.
ROTATE_BYTES, KEEP = 10 << 20, 3
_PHASE, _KEY = re.compile(r"\d[\w.]*"), re.compile(r"[A-Za-z_]\w*")


@contextlib.contextmanager
def writer_lock(path: str) -> Iterator[bool]:
    """Whether the lock was free; it is held until the end of the block."""
    with open(f"{path}.lock", "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            yield False
            return
        try:
            yield True
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def _append(path: str, entry: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True, separators=(",", ":")) + "\n")
        f.flush()
        os.fsync(f.fileno())


def rotate(path: str, limit: int = ROTATE_BYTES, keep: int = KEEP) -> bool:
    """Put a journal of ``limit`` bytes or more away as ``path.1.gz``, older ones move up, the oldest goes."""
    if not os.path.exists(path) or os.path.getsize(path) < limit:
        return False
    for i in range(keep, 0, -1):
        old = f"{path}.{i}.gz"
        if os.path.exists(old):
            os.remove(old) if i == keep else os.replace(old, f"{path}.{i + 1}.gz")
    with open(path, "rb") as src, gzip.open(f"{path}.1.gz.part", "wb") as dst:
        while block := src.read(1 << 20):
            dst.write(block)
    os.replace(f"{path}.1.gz.part", f"{path}.1.gz")
    os.remove(path)
    return True


def journaled(path: str, op: str, args: dict, version: int, content_sha: str | None, ts: str, change: Callable[[], None]) -> str | None:
    """Write an intent, make the change, acknowledge it; the entry's id, or None if another writer is at work."""
    with writer_lock(path) as free:
        if not free:
            return None
        rotate(path)
        entry = {"id": uuid.uuid4().hex, "ts": ts, "op": op, "args": args, "prev_user_version": version, "content_sha": content_sha, "schema_version": 1}
        _append(path, entry)
        change()
        _append(path, {"ack": True, "id": entry["id"]})
        return entry["id"]


def append_marker(path: str, ts: str, phase: str, status: str, payload: dict[str, str]) -> None:
    """Append a phase marker line; a phase, status or key that readers wouldn't take is refused."""
    if not _PHASE.fullmatch(phase) or not re.fullmatch(r"[A-Z]+", status):
        raise ValueError("no such phase or status")
    if not payload or any(not _KEY.fullmatch(k) or re.search(r"\s", v) for k, v in payload.items()):
        raise ValueError("a payload needs keys, and values without blanks")
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"[{ts}] PHASE_{phase} {status} — {' '.join(f'{k}={v}' for k, v in payload.items())}\n")
