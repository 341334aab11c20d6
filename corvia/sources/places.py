"""Single files from tasks: hashed, copied and put in place through the file system of their address.

Addresses are paths or URIs that Arrow knows (file, hdfs, s3, gs). A file is written in full beside its place and then
renamed, so that others see it whole or not at all, and a task that is run again does no harm.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyarrow import fs as pafs

BLOCK = 1 << 20


def at(address: str) -> tuple[pafs.FileSystem, str]:
    address = address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file:///") else address
    return pafs.FileSystem.from_uri(address) if "://" in address else (pafs.LocalFileSystem(), os.path.abspath(address))


def is_file(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def digest(fs: pafs.FileSystem, path: str) -> str | None:
    """SHA-256 of a file, a block at a time; None if there is none."""
    if not is_file(fs, path):
        return None
    state = hashlib.sha256()
    with fs.open_input_stream(path) as stream:
        while block := stream.read(BLOCK):
            state.update(block)
    return state.hexdigest()


def beside(fs: pafs.FileSystem, path: str) -> str:
    folder, _, name = path.rpartition("/")
    if folder:
        fs.create_dir(folder, recursive=True)
    return f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"


def take_place(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    """Rename, in place of what is there; where a rename can't replace, what is there goes first."""
    try:
        fs.move(temporary, path)
    except OSError:
        if not is_file(fs, path):
            raise
        fs.delete_file(path)
        fs.move(temporary, path)


def put(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    temporary = beside(fs, path)
    with fs.open_output_stream(temporary) as out:
        out.write(content)
    take_place(fs, temporary, path)


def copy(source: tuple[pafs.FileSystem, str], target: tuple[pafs.FileSystem, str]) -> tuple[str, str]:
    """A copy beside the target, not yet in its place: its name and the hash of what was read."""
    temporary, state = beside(*target), hashlib.sha256()
    with source[0].open_input_stream(source[1]) as stream, target[0].open_output_stream(temporary) as out:
        while block := stream.read(BLOCK):
            state.update(block)
            out.write(block)
    return temporary, state.hexdigest()
