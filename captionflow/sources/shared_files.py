"""Files on storage that the driver and all executors share, as Python tasks see it.

Spark's own writers cover tables. The writers of files in formats of their own (flat
binary files, one JSON document from many rows) open their files through Arrow's
filesystems, which take the same addresses (local or mounted paths, ``file:``,
``hdfs:``, ``s3:``, ``gs:``).

Commit rule of these writers: a task writes files under names of its own attempt; the
driver's commit, which runs once after all tasks have succeeded, writes a list of the
files that count and puts it in place with one move. Files of attempts that failed are
in no list; the commit deletes those it sees.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of an address and the path in it. Addresses are as Spark writes
    them: names are not escaped."""
    local = re.sub(r"^file:/+", "/", path)
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(/?.*)$", local, re.DOTALL)
    if m is None:
        return pafs.LocalFileSystem(), local.rstrip("/") or "/"
    found, root = pafs.FileSystem.from_uri(m[1] + "/")
    return found, (root.rstrip("/") + m[2]).rstrip("/")


def names_in(files: pafs.FileSystem, folder: str) -> list[str]:
    """Names of the files directly in a folder; none if there is no such folder."""
    at = pafs.FileSelector(folder, recursive=False, allow_not_found=True)
    return sorted(x.base_name for x in files.get_file_info(at) if x.type == pafs.FileType.File)


def read_json(files: pafs.FileSystem, path: str):
    """The JSON value of a small file, None if it does not exist."""
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def put_json(files: pafs.FileSystem, path: str, value) -> None:
    """Write a small JSON file whole: a reader sees the old file or the new one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(json.dumps(value, ensure_ascii=False).encode())
    files.move(part, path)
