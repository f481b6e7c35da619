"""Archive members as rows, nested archives included."""

from __future__ import annotations

import calendar
import io
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import make_link, open_file, set_attributes, write_parts

MEMBERS = "archive string, path string, depth int, size long, mode int, mtime long, content binary, link string, problem string"
SUFFIXES = (".zip", ".tar.gz", ".tgz", ".tar")
#: Bytes of content after which rows are passed on.
BATCH = 32 << 20


class Member(NamedTuple):
    path: str
    depth: int = 0
    size: int = 0
    mode: int = 0
    mtime: int = 0
    read: Callable[[], bytes] | None = None
    link: str | None = None
    problem: str | None = None


def safe(path: str) -> bool:
    """Whether a member stays below the folder it is unpacked to."""
    clean = posixpath.normpath(path)
    return not (clean.startswith(("/", "../")) or clean == "..")


def members(name: str, file: BinaryIO) -> Iterator[Member]:
    """Files and links in order, contents unread; an unsafe path ends the archive, an unsafe link is only told of."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if not safe(info.filename):
                    yield Member(info.filename, problem="unsafe path")
                    return
                if not info.is_dir():
                    yield Member(info.filename, 0, info.file_size, info.external_attr >> 16, calendar.timegm((*info.date_time, 0, 0, 0)), lambda i=info: z.read(i))
        return
    with tarfile.open(fileobj=file, mode="r:*") as t:
        for info in t:
            if not safe(info.name):
                yield Member(info.name, problem="unsafe path")
                return
            if info.issym():
                bad = not safe(posixpath.join(posixpath.dirname(info.name), info.linkname))
                yield Member(info.name, 0, 0, info.mode, int(info.mtime), None, info.linkname, "unsafe link" if bad else None)
            elif info.isreg():
                yield Member(info.name, 0, info.size, info.mode, int(info.mtime), lambda i=info: t.extractfile(i).read())
            t.members = []  # else every header met is kept


def walk(name: str, file: BinaryIO, max_depth: int, folder: str = "", depth: int = 0) -> Iterator[Member]:
    """Members of an archive and of those in it, under the paths they unpack to. Only nested archives are read."""
    try:
        for m in members(name, file):
            full = posixpath.normpath(posixpath.join(folder, m.path)) if m.problem != "unsafe path" else m.path
            if m.read and m.path.lower().endswith(SUFFIXES) and depth < max_depth:
                yield from walk(m.path, io.BytesIO(m.read()), max_depth, posixpath.dirname(full), depth + 1)
            else:
                yield m._replace(path=full, depth=depth)
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError) as e:
        yield Member(posixpath.join(folder, name), depth, problem=f"broken: {type(e).__name__}")


BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, RuntimeError)


def _row(archive: str, m: Member) -> tuple:
    problem, content = m.problem, None
    try:
        content = m.read() if m.read else None
    except BROKEN as e:
        problem = f"broken: {type(e).__name__}"
    return archive, m.path, m.depth, len(content) if content is not None else m.size, m.mode, m.mtime, content, m.link, problem


def last_rows(archive: str, begin: Callable[[], BinaryIO], max_depth: int) -> Iterator[tuple]:
    """A row for each path of an archive, the last one of equal paths, in the order of those.

    One walk, as long as what it reads stays below ``BATCH``; beyond it the archive is walked for its paths, then once more.
    """
    try:
        held: dict[str, tuple] = {}
        size = 0
        for m in walk(archive, begin(), max_depth):
            size += m.size + 200
            if size > BATCH:
                break
            held.pop(m.path, None)
            held[m.path] = _row(archive, m)
        else:
            yield from held.values()
            return
        held.clear()
        last = {m.path: k for k, m in enumerate(walk(archive, begin(), max_depth))}
    except OSError as e:  # of the file itself
        yield archive, archive, 0, 0, 0, 0, None, None, f"broken: {type(e).__name__}"
        return
    for k, m in enumerate(walk(archive, begin(), max_depth)):
        if last.get(m.path) == k:
            yield _row(archive, m)


def expand(archives: DataFrame, max_depth: int = 5) -> DataFrame:
    """A row for each file and link of archives (path, and content; without content they are opened by their path).

    Nested archives are opened in turn, at most ``max_depth`` deep, and give their members beside them; broken ones give
    a row with a problem. Of equal paths the last holds. A task holds one member and about 32 MB of others, not a whole archive unpacked.
    """

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string())
        names = [x.split()[0] for x in MEMBERS.split(", ")]
        held: list[tuple] = []
        size = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*held)) or [()] * len(kinds), kinds)], names)

        for b in batches:
            contents = b.column(1) if b.num_columns > 1 else [None] * b.num_rows
            for archive, data in zip(b.column(0).to_pylist(), contents):
                begin = (lambda d=data: io.BytesIO(d.as_py())) if data is not None else (lambda a=archive: open_file(a))
                for row in last_rows(archive, begin, max_depth):
                    held.append(row)
                    size += len(row[6] or b"") + 200
                    if size > BATCH:
                        yield passed_on()
                        held, size = [], 0
        yield passed_on()

    columns = [c for c in ("path", "content") if c in archives.columns]
    return archives.select(*columns).mapInArrow(run, MEMBERS)


def materialise(found: DataFrame, folder: str) -> DataFrame:
    """Write members as files below ``folder``, with their permissions and times, and links as links; archive, path, written
    (bytes, 0 for a link, null where there was nothing to write or the store has no links).

    Archives unpack to a folder each, named by a digest of their path, as equal member paths of two may not meet.
    """
    def run(batches):
        import pyarrow as pa

        for b in batches:
            wrote = []
            for path, key, content, link, mode, mtime in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), *(b.column(k).to_pylist() for k in (4, 5, 6))):
                to = f"{folder}/{key}/{path}"
                if content.is_valid:
                    wrote.append(write_parts(to, [content.as_py()]))
                    set_attributes(to, mode, mtime)
                else:
                    wrote.append(0 if link is not None and make_link(to, link) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(wrote, pa.int64())], ["archive", "path", "written"])

    fine = F.col("problem").isNull()
    rows = found.select("archive", "path", F.md5("archive"), F.when(fine, F.col("content")), F.when(fine, F.col("link")), "mode", "mtime")
    return rows.mapInArrow(run, "archive string, path string, written long")
