"""Files that tasks write and read themselves, on any store that pyarrow reaches by URI."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def create(folder: str, name: str):
    """A stream to a new file; names are unique per task attempt, so no attempt spoils another's."""
    system, path = store(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def read_spans(folder: str, wanted: Iterable[tuple[str, int, int]], gap: int = 1 << 16, most: int = 1 << 23) -> dict:
    """{(name, offset): bytes} of (name, offset, length); near spans of a file are read at once."""
    system, path = store(folder)
    found, spans = {}, sorted(set(wanted))
    k, name, file = 0, None, None
    while k < len(spans):
        if spans[k][0] != name:
            if file:
                file.close()
            name = spans[k][0]
            file = system.open_input_file(f"{path}/{name}")
        start, end = spans[k][1], spans[k][1] + spans[k][2]
        last = k + 1
        while last < len(spans) and spans[last][0] == name and spans[last][1] - end <= gap and spans[last][1] + spans[last][2] - start <= most:
            end = max(end, spans[last][1] + spans[last][2])
            last += 1
        data = file.read_at(end - start, start)
        for _, offset, n in spans[k:last]:
            found[name, offset] = data[offset - start : offset - start + n]
        k = last
    if file:
        file.close()
    return found
