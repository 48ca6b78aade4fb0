"""Files in any store that Arrow reaches, named by URI, written so that a retried task does no harm."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (a plain path is local) and the path in it. Hadoop's names of S3 are Arrow's."""
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri.removeprefix(scheme)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@contextmanager
def replacing(uri: str) -> Iterator:
    """An output stream that takes the name only when it is complete."""
    system, path = opened(uri)
    parent = path.rpartition("/")[0]
    system.create_dir(parent, recursive=True)
    temporary = f"{parent}/.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
        system.move(temporary, path)
    except BaseException:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)
        raise


def delete(uri: str) -> None:
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
