"""Catalogs and files over HTTP, in tasks; at most ``parallel`` of them run at once."""

from __future__ import annotations

import hashlib
import http.client
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .files import open_file, write_parts

#: Seconds before the second try; doubled for each one after it.
FIRST_WAIT = 0.005
PART = 1 << 20
FAILURES = (http.client.HTTPException, OSError, ValueError)


def tried(attempt, retries: int):
    """(result, tries, problem) of a call that is repeated up to ``retries`` times if it fails."""
    for k in range(retries + 1):
        try:
            return attempt(), k + 1, None
        except FAILURES as e:
            problem = f"{type(e).__name__}: {e}"
            if k < retries:
                time.sleep(FIRST_WAIT * 2**k)
    return None, retries + 1, problem


def parts_of(url: str, timeout: float) -> Iterator[bytes]:
    with urllib.request.urlopen(url, timeout=timeout) as got:
        if got.status != 200:
            raise OSError(f"status {got.status}")
        expected, size = got.headers.get("Content-Length"), 0
        while part := got.read(PART):
            size += len(part)
            yield part
        if expected is not None and size != int(expected):
            raise OSError(f"{size} of {expected} bytes")


def read_catalog_http(spark: SparkSession, base_url: str, products: list[int], retries: int = 3, timeout: float = 30.0, parallel: int = 5) -> DataFrame:
    """Catalog entries of the products, and ``problem`` of those that can't be had (their other fields are null)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [tried(lambda u=f"{base_url}/products/{i}": b"".join(parts_of(u, timeout)).decode(), retries) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["json", "problem"])

    asked = spark.createDataFrame([(i,) for i in products], "id long").repartition(parallel)
    rows = asked.mapInArrow(run, "json string, problem string")
    return rows.select(F.from_json("json", schemas.CATALOG).alias("p"), "problem").select("p.*", "problem")


def sha1_of(uri: str) -> str | None:
    """Hex digest of a file, read part by part; None if there is none."""
    try:
        with open_file(uri) as f:
            digest = hashlib.sha1()
            while part := f.read(PART):
                digest.update(part)
            return digest.hexdigest()
    except FileNotFoundError:
        return None


def fetch(url: str, target: str, checksum: str | None, skip_existing: bool, verify: bool, retries: int, timeout: float) -> tuple[str, int, str | None, int, str | None]:
    """(outcome, bytes, SHA-1, tries, problem): skipped, ok, mismatch or failed. A file of the wrong digest isn't kept."""
    if skip_existing and checksum and sha1_of(target) == checksum:
        return "skipped", 0, checksum, 0, None

    def attempt():
        digest = hashlib.sha1()

        def parts():
            for part in parts_of(url, timeout):
                digest.update(part)
                yield part
            if verify and checksum and digest.hexdigest() != checksum:
                raise OSError("checksum")

        return write_parts(target, parts()), digest.hexdigest()

    got, tries, problem = tried(attempt, retries)
    if got:
        return "ok", got[0], got[1], tries, None
    return "mismatch" if problem == "OSError: checksum" else "failed", 0, None, tries, problem


def download(tasks: DataFrame, folder: str, skip_existing: bool = True, verify: bool = True, retries: int = 3, timeout: float = 30.0, parallel: int = 5) -> DataFrame:
    """file_path, checksum, url of tasks with target, outcome, bytes, sha1, tries and problem.

    A task writes to a name of its own and moves the file when it is whole, so one that is run again, after a lost executor, finds it
    and skips it, or writes it anew. Write the result once: each evaluation asks the server again for what isn't skipped.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            targets = [f"{folder}/{path}" for path, _, _ in rows]
            got = [fetch(url, to, checksum, skip_existing, verify, retries, timeout) for to, (_, checksum, url) in zip(targets, rows)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
            new = [pa.array(x, t) for x, t in zip(list(zip(*got)) or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(targets, pa.string()), *new], ["file_path", "checksum", "url", "target", "outcome", "bytes", "sha1", "tries", "problem"])

    asked = tasks.select("file_path", "checksum", "url").repartition(parallel)
    return asked.mapInArrow(run, "file_path string, checksum string, url string, target string, outcome string, bytes long, sha1 string, tries int, problem string")
