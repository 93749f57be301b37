"""Files cut into byte ranges, one for each task, whatever their number and sizes."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

#: Bytes of a range, and of what is held of it at once.
RANGE, CHUNK = 64 << 20, 4 << 20


def file_system(path: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def files_of(path: str) -> list[tuple[str, int]]:
    """Names (with their file system) and sizes of a file, of the files in a folder, or of what a glob in the last part matches; by name.

    Hidden names, which begin with . or _, are left out.
    """
    from pyarrow import fs

    system, at = file_system(path)
    head = path[: len(path) - len(at)]
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = system.get_file_info(fs.FileSelector(folder))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        one = system.get_file_info(at)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    kept = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [(head + f.path, f.size) for f in sorted(kept, key=lambda f: f.path)]


@dataclass
class ByteRange(InputPartition):
    """Bytes start to stop of a file, and the number of the first element in them."""

    path: str
    start: int
    stop: int
    first: int = 0


def ranges_of(path: str, size: int, start: int, stop: int, first: int = 0, most: int = RANGE) -> list[ByteRange]:
    """Ranges of whole elements of `size` bytes that lie from start to stop in a file."""
    step = max(1, most // size) * size
    return [ByteRange(path, at, min(at + step, stop), first + (at - start) // size) for at in range(start, stop, step)]


def chunks(part: ByteRange, size: int, most: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """The range's content in chunks of whole elements, each with the number of its first one."""
    step = max(1, most // size) * size
    system, at = file_system(part.path)
    with system.open_input_file(at) as source:
        for begin in range(part.start, part.stop, step):
            yield part.first + (begin - part.start) // size, source.read_at(min(step, part.stop - begin), begin)
