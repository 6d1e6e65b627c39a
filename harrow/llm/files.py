"""Whole files in the shared folder, written and range-read by tasks through any file system that Arrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from harrow.sources.files import locate


@contextmanager
def write_once(uri: str) -> Iterator:
    """A stream to a file that appears under its name only when it is complete: a retried task leaves no half file."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as out:
            yield out
    except BaseException:
        system.delete_file(part)
        raise
    system.move(part, path)


def read_range(source, start: int, length: int) -> bytes:
    source.seek(start)
    return source.read(length)
