"""Files by URI, for tasks: any executor can open what a shared path names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a URI (file, s3, gs, hdfs) or of a plain local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def open_file(uri: str) -> pa.NativeFile:
    """A seekable file to read."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def write_parts(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file part by part under another name, then move it there: readers never meet half a file. Its size."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    other, size = f"{path}.{uuid.uuid4().hex}.part", 0
    try:
        with fs.open_output_stream(other, compression=None) as f:
            for part in parts:
                f.write(part)
                size += len(part)
        fs.move(other, path)
    except BaseException:
        if fs.get_file_info(other).type == pafs.FileType.File:
            fs.delete_file(other)
        raise
    return size


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="patentframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_attributes(uri: str, mode: int, mtime: int) -> None:
    """Permissions and time of change, where the store has them."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if mode & 0o777:
            os.chmod(path, mode & 0o777)
        os.utime(path, (mtime, mtime))


def make_link(uri: str, target: str) -> bool:
    """A symbolic link, where the store has them; one that is there is replaced."""
    fs, path = filesystem(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    other = f"{path}.{uuid.uuid4().hex}.part"
    os.symlink(target, other)
    os.replace(other, path)
    return True
