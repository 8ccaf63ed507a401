"""Archives: safe unpacking with fingerprints, nesting, and reuse of what is already unpacked.

Unpacking touches the file system of the machine it runs on, so it is a preparation job, not a query.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import zipfile
from collections import deque
from pathlib import Path, PurePosixPath

SUFFIXES = (".tar.gz", ".tar.bz2", ".tar.xz", ".tgz", ".tbz2", ".txz", ".zip", ".tar")
MARKER = ".extracted.json"


def is_archive(path: Path) -> bool:
    return path.is_file() and path.name.lower().endswith(SUFFIXES)


def stem(path: Path) -> str:
    low = path.name.lower()
    return next((path.name[: -len(s)] for s in SUFFIXES if low.endswith(s)), path.stem)


def fingerprint(path: Path) -> str:
    info = path.stat()
    return hashlib.sha1(f"{path.resolve()}|{info.st_size}|{info.st_mtime_ns}".encode()).hexdigest()[:12]


def safe(member: str) -> bool:
    parts = PurePosixPath(member.replace("\\", "/")).parts
    return bool(parts) and not member.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts


def unpack(archive: Path, below: Path) -> Path:
    """Unpack into ``below/<stem>-<fingerprint>``; complete or not at all."""
    mark = fingerprint(archive)
    target = below / f"{stem(archive)}-{mark}"
    if (target / MARKER).is_file() and json.loads((target / MARKER).read_text()).get("fingerprint") == mark:
        return target
    part = below / f".{target.name}.part"
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    if archive.name.lower().endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            for info in z.infolist():
                linked = (info.external_attr >> 16) & 0o170000 == 0o120000
                if not safe(info.filename) or linked:
                    raise ValueError(f"unsafe member {info.filename!r} in {archive}")
            z.extractall(part)
    else:
        with tarfile.open(archive) as t:
            for info in t.getmembers():
                if not safe(info.name) or not (info.isfile() or info.isdir()):
                    raise ValueError(f"unsafe member {info.name!r} in {archive}")
            t.extractall(part, filter="data")
    (part / MARKER).write_text(json.dumps({"fingerprint": mark, "archive": str(archive)}))
    shutil.rmtree(target, ignore_errors=True)
    os.replace(part, target)
    return target


def unpack_all(root: Path, deepest: int = 5) -> list[Path]:
    """Unpack every archive below ``root/archives``, and archives inside those, breadth first.

    What was unpacked from archives that are gone is removed; without any archive nothing is touched.
    """
    below = root / "_extracted"
    waiting = deque((p, 0) for p in sorted((root / "archives").rglob("*")) if is_archive(p))
    if not waiting:
        return sorted(p for p in below.glob("*") if (p / MARKER).is_file())
    found = []
    while waiting:
        archive, depth = waiting.popleft()
        if depth > deepest:
            raise ValueError(f"{archive} is nested more than {deepest} deep")
        target = unpack(archive, below)
        found.append(target)
        waiting.extend((p, depth + 1) for p in sorted(target.rglob("*")) if is_archive(p))
    for old in below.glob("*"):
        if old.is_dir() and old not in found:
            shutil.rmtree(old)
    return found


def place(source: Path, target: Path) -> None:
    """A hard link, else a symbolic link, else a copy; an existing file stays."""
    if target.exists():
        return
    target.parent.mkdir(parents=True, exist_ok=True)
    for way in (os.link, lambda a, b: os.symlink(Path(a).resolve(), b), shutil.copy2):
        try:
            way(source, target)
            return
        except OSError:
            continue
    raise OSError(f"cannot place {source} at {target}")
