"""Content by URI, trees of a folder, and repositories as archives.

Executors open what they read; a URI's scheme decides how. Nothing is fetched
while a plan is made.
"""

from __future__ import annotations

import io
import json
import tarfile
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[str], bytes]


def _web(uri: str) -> bytes:
    with urllib.request.urlopen(uri, timeout=60) as r:
        return r.read()


def _storage(uri: str) -> bytes:
    """Any file system that Arrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def _local(uri: str) -> bytes:
    with open(unquote(urlparse(uri).path) if uri.startswith("file:") else uri, "rb") as f:
        return f.read()


LOADERS: dict[str, Loader] = {"": _local, "file": _local, "http": _web, "https": _web, "s3": _storage, "gs": _storage, "hdfs": _storage}


def resolve(uris: DataFrame, uri_col: str = "uri", loaders: Mapping[str, Loader] | None = None) -> DataFrame:
    """(uri, content, error): the bytes behind every URI, or why there are none."""
    known = LOADERS | dict(loaders or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                content, error = None, None
                try:
                    scheme = urlparse(uri or "").scheme
                    if not uri or scheme not in known:
                        raise ValueError(f"no loader for {uri!r}")
                    content = known[scheme](uri)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["uri", "content", "error"])

    return uris.select(F.col(uri_col).alias("uri")).mapInArrow(run, "uri string, content binary, error string")


def list_tree(spark: SparkSession, uri: str) -> DataFrame:
    """(uri, name, is_dir, size) of the entries of one folder, which the driver lists."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{quote(uri)}")
    head = uri.rstrip("/")
    rows = [(f"{head}/{x.base_name}", x.base_name, x.type == fs.FileType.Directory, int(x.size or 0)) for x in system.get_file_info(fs.FileSelector(path))]
    return spark.createDataFrame(sorted(rows), "uri string, name string, is_dir boolean, size bigint")


def archive_uris(spark: SparkSession, repositories: list[str], host: str, ref: str = "HEAD") -> DataFrame:
    """(repository, uri): where a code host serves the tar archive of each ``owner/name``."""
    return spark.createDataFrame([(r, f"https://{host}/repos/{quote(r)}/tarball/{quote(ref)}") for r in repositories], "repository string, uri string")


def unpack(archives: DataFrame, content_col: str = "content", max_file: int = 1 << 20) -> DataFrame:
    """(uri, path, content) of the regular files of tar archives, plain or compressed, without the folder that all of them are in.

    Files over ``max_file`` bytes, and those with a zero byte in their first
    kilobyte, are no source code and left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw is None:
                    continue
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
                    for m in tar:
                        if not m.isfile() or m.size > max_file:
                            continue
                        data = tar.extractfile(m).read()
                        if b"\0" in data[:1024]:
                            continue
                        path = m.name.split("/", 1)[-1]
                        yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([path], pa.string()), pa.array([data.decode("utf-8", "replace")], pa.string())], ["uri", "path", "content"])

    return archives.where(F.col(content_col).isNotNull()).select("uri", content_col).mapInArrow(run, "uri string, path string, content string")


def contents(pages: DataFrame, json_col: str = "value") -> DataFrame:
    """(path, content) of the files that a code host's contents interface lists with their text in base64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        for b in batches:
            rows = []
            for page in b.column(0).to_pylist():
                found = json.loads(page)
                for x in found if isinstance(found, list) else [found]:
                    if x.get("type", "file") == "file" and x.get("content") is not None:
                        raw = base64.b64decode(x["content"]) if x.get("encoding", "base64") == "base64" else x["content"].encode()
                        rows.append({"path": x["path"], "content": raw.decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.string())]))

    return pages.select(json_col).mapInArrow(run, "path string, content string")
