"""Messages from folders, archives and mailboxes, as (source_id, member, ordinal, content, error)."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.mime import LIMITS

#: Largest archive member that is read; larger ones become rows with an error.
MEMBER_BYTES = 268_435_456


def eml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, error) of the .eml files below a folder, or of one file.

    Oversize files keep their row with an error and no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").load(path)
    big = F.col("length") > LIMITS["bytes"]
    return files.select("path", "length", F.when(~big, F.col("content")).alias("content"), F.when(big, "oversize").alias("error"))


def safe_member(name: str) -> bool:
    """False for absolute names and those that climb out of the archive."""
    parts = re.split(r"[\\/]", name)
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match(r"^[A-Za-z]:", name)


def tar_members(data: bytes, exclude: frozenset[str] = frozenset()) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, error) of the regular members in the order of their names; refused ones keep a row."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in sorted((x for x in t.getmembers() if x.isfile() and x.name not in exclude), key=lambda x: x.name):
            if not safe_member(m.name):
                yield m.name, None, "unsafe name"
            elif m.size > MEMBER_BYTES:
                yield m.name, None, "oversize"
            else:
                yield m.name, t.extractfile(m).read(), None


def mbox_messages(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(ordinal, content, error) of a mailbox's messages.

    A line that begins with "From " separates only at the start or after a blank line.
    """
    message: list[bytes] | None = None
    blank, no = True, 0
    for line in data.splitlines(keepends=True):
        if blank and line.startswith(b"From "):
            if message is not None:
                yield f"{no:04d}", b"".join(message), None
            message, no = [], no + 1
        elif message is not None:
            message.append(line)
        blank = not line.strip(b"\r\n")
    if message is None:
        yield "0000", None, "no separator"
    else:
        yield f"{no:04d}", b"".join(message), None


def archive_messages(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Messages of the acquired sources: kind ``tar.bz2`` (any tar) or ``mbox``.

    One task per archive: compressed archives cannot be read in parts.
    """
    known = {"tar.bz2": tar_members, "tar": tar_members, "mbox": lambda x, _=None: mbox_messages(x)}
    frames = []
    for s in sources:
        if s.get("status") != "acquired":
            continue
        if s["kind"] not in known:
            raise NotImplementedError(f"source kind {s['kind']}")
        exclude = frozenset(s.get("exclude_members") or ())
        read, sid = known[s["kind"]], s["id"]

        def run(batches: Iterator[pa.RecordBatch], read=read, exclude=exclude, sid=sid) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    try:
                        for i, (name, content, error) in enumerate(read(data, exclude) if read is tar_members else read(data)):
                            yield pa.RecordBatch.from_pylist(
                                [{"source_id": sid, "path": path, "member": name, "ordinal": f"{sid}_{i + 1:05d}", "content": content, "error": error}], schema=_ARROW
                            )
                    except (tarfile.TarError, EOFError, OSError) as e:
                        yield pa.RecordBatch.from_pylist([{"source_id": sid, "path": path, "member": None, "ordinal": None, "content": None, "error": f"{type(e).__name__}: {e}"}], schema=_ARROW)

        files = spark.read.format("binaryFile").load(s["path"]).select("path", "content")
        frames.append(files.mapInArrow(run, _DDL))
    if not frames:
        return spark.createDataFrame([], _DDL)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_DDL = "source_id string, path string, member string, ordinal string, content binary, error string"
_ARROW = pa.schema([("source_id", pa.string()), ("path", pa.string()), ("member", pa.string()), ("ordinal", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def registry(spark: SparkSession, path: str) -> list[dict]:
    """Source entries of a JSON registry: required keys present, ids unique."""
    rows = [r.asDict(True) for r in spark.read.option("multiLine", True).json(path).select(F.explode("sources").alias("s")).select("s.*").collect()]
    need = {"id", "kind", "path", "status"}
    for r in rows:
        if missing := need - {k for k, v in r.items() if v is not None}:
            raise ValueError(f"source {r.get('id')}: missing {sorted(missing)}")
    ids = [r["id"] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("source ids repeat")
    return rows


def verified(messages: DataFrame, wanted: DataFrame, keys: list[str], sha: str) -> tuple[DataFrame, DataFrame]:
    """(read, problems): wanted archive members joined to their bytes, hashes compared."""
    both = wanted.join(messages.select(*keys, "content"), keys, "left")
    problem = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col(sha), "hash differs")
    marked = both.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").select(*keys, "problem")
