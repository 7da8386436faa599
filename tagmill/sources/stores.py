"""Ranged reads of large files inside tasks, from local disks and the object stores that pyarrow knows."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs


def opened(path: str):
    """A file that can be read at any place."""
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def listed(root: str, endings: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """(address, bytes) of the file ``root``, or of the files below the folder ``root`` with one of the endings, in order."""
    store, inside = fs.FileSystem.from_uri(root)
    scheme = root.split("://", 1)[0] + "://" if "://" in root else ""
    one = store.get_file_info(inside)
    found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    for f in sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path):
        if f.path.lower().endswith(endings):
            yield scheme + f.path, f.size
