"""Folders of files that many tasks write and one commit makes visible.

Tasks write files under names of their own job. They count only when a manifest lists them: manifests are numbered,
each is written under a temporary name and moved to its number last, so readers see all of a job or nothing. Stores
are those that pyarrow reaches by URI.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

MANIFESTS, JOBS = "_manifests", "_jobs"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; one without a scheme is local."""
    path = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def _files(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    return [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]


def manifest(path: str) -> tuple[int, list[dict] | None]:
    """Number and entries of the newest manifest; 0 and None where there is none."""
    store, root = opened(path)
    numbers = [int(f.base_name) for f in _files(store, f"{root}/{MANIFESTS}") if f.base_name.isdigit()]
    if not numbers:
        return 0, None
    with store.open_input_stream(f"{root}/{MANIFESTS}/{max(numbers):010d}", compression=None) as f:
        return max(numbers), json.loads(f.read())


def publish(path: str, entries: list[dict], number: int) -> None:
    """Makes `entries` what the folder holds. Manifests before the last but one go."""
    store, root = opened(path)
    at = f"{root}/{MANIFESTS}"
    store.create_dir(at, recursive=True)
    with store.open_output_stream(draft := f"{at}/.{uuid.uuid4().hex}", compression=None) as f:
        f.write(json.dumps(entries).encode())
    store.move(draft, f"{at}/{number:010d}")
    for old in _files(store, at):
        if old.base_name.isdigit() and int(old.base_name) < number - 1:
            store.delete_file(old.path)


def listed(path: str, *suffixes: str) -> list[dict]:
    """Entries of the newest manifest; where there is none, the folder's files with such names, or the one file."""
    entries = manifest(path)[1]
    if entries is not None:
        return entries
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else _files(store, root)
    return sorted(({"name": f.base_name, "bytes": f.size} for f in found if f.path == root or f.base_name.endswith(suffixes)), key=lambda e: e["name"])


def place(path: str, name: str) -> str:
    """Where a listed file is, within its store."""
    root = opened(path)[1]
    return root if os.path.basename(root) == name else f"{root}/{name}"


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


class FolderWriter(DataSourceArrowWriter):
    """A writer whose tasks' files appear with the commit. Until then they are in a folder of the job's own, which goes
    with all that failed, killed and doubled attempts left in it."""

    def __init__(self, path: str, overwrite: bool, suffix: str) -> None:
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex
        store, root = opened(path)
        store.create_dir(f"{root}/{JOBS}/{self.job}", recursive=True)

    def new_name(self, number: int = 0) -> str:
        """A name that no other attempt of a task has; names of a job sort as its partitions do."""
        task = TaskContext.get()
        return f"part-{task.partitionId():06d}-{number:04d}-{self.job}-{task.taskAttemptId()}{self.suffix}"

    def draft(self, name: str) -> str:
        """Where a file is before the commit, within its store."""
        return f"{opened(self.path)[1]}/{JOBS}/{self.job}/{name}"

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        entries = sorted((e for m in messages if m for e in m.entries), key=lambda e: e["name"])
        for e in entries:
            store.move(self.draft(e["name"]), f"{root}/{e['name']}")
        number, old = manifest(self.path)
        publish(self.path, entries if self.overwrite else (old or []) + entries, number + 1)
        store.delete_dir(f"{root}/{JOBS}/{self.job}")
        for e in (old or []) if self.overwrite else []:
            store.delete_file(f"{root}/{e['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.delete_dir(f"{root}/{JOBS}/{self.job}")
