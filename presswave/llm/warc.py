"""Deterministic sharded WARC archives: write, commit and read back.

Records are range-sorted by (id, digest). The number of shards comes from the payload's bytes and the bounds
from the keys of least hash, so the same rows give the same files, whatever the session's settings. Each
task writes its range as gzip members (one per record), starts a new file when the compressed size passes
``roll_bytes``, and regenerates every header and digest from the payload. Files are written under temporary
names that hold the task attempt; the rows that tasks return are the manifest, saved by Spark's committer,
so only successful attempts are in it. A second job moves the manifest's files to their final names; then
the temporary folder goes. An archive is written once: a path that holds one is an error.

The first use of a payload is told by its SHA-1: of equal payloads of ``min_bytes`` or more, the record
with the largest id is a response and the others revisit it. Digests are grouped with partial aggregates
and only (id, digest, target) rows are joined; the payload crosses the network once.

Rows: null html is an empty payload, a null url an empty target. Rows that repeat an id are all written;
all rows with the largest id of a payload are responses. A null id counts as smaller than any other.
Extra columns are ignored. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswave.storage import materialize, scratch_path

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, most shards (beyond that they grow), and keys sampled for each shard's bounds.
SHARD_BYTES, MOST_SHARDS, SAMPLED = 16 << 20, 4096, 32
LONG = "bigint"
MANIFEST = "shard int, seq int, temporary string, final string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace(":/", ":///", 1))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, target: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``target`` set) has no payload but names its length and digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = payload if target is None else b""
    heads = {
        "WARC-Type": "response" if target is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(url.split("\r")).replace("\n", ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
    }
    if target is not None:
        heads |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(target, digest), "X-Refers-To-Page": str(target)}
    heads["Content-Length"] = str(len(body))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads.items()) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def heads(pages: DataFrame) -> DataFrame:
    """page_id, digest and size of every payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))


def planned(head: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest, target: what each record will be, without its payload."""
    owners = head.groupBy("digest").agg(F.max("page_id").alias("owner"))
    same = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("owner"))
    return head.join(owners, "digest").groupBy("page_id", "digest").agg(F.max(F.when(~same, F.col("owner"))).alias("target"))


def shard_bounds(head: DataFrame, shard_bytes: int = SHARD_BYTES, most: int = MOST_SHARDS) -> list[tuple[int, str]]:
    """The least keys (id, digest) of all shards but the first.

    Quantiles of the keys whose hash is below a bound: about ``SAMPLED`` a shard, so at most ``SAMPLED`` *
    ``MOST_SHARDS`` on average come to the driver; up to that number of rows all do.
    """
    total = head.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    shards = max(1, min(most, -(-(total["bytes"] or 0) // shard_bytes)))
    wanted, parts = shards * SAMPLED, 1 << 40
    if shards == 1:
        return []
    below = parts if total["rows"] <= wanted else int(parts * wanted / total["rows"])
    key = F.xxhash64("page_id", "digest")
    keys = head.filter("page_id IS NOT NULL").filter(F.pmod(key, F.lit(parts)) < below).select("page_id", "digest").collect()
    keys = sorted({(r["page_id"], r["digest"]) for r in keys})
    return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []


def shard_of(bounds: list[tuple[int, str]]):
    """A pandas UDF: how many bounds are at or below (id, digest); a null id is below all."""
    ids = np.array([x[0] for x in bounds], dtype=np.int64)

    @F.pandas_udf("int")
    def udf(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        some = page_id.notna().to_numpy()
        own = page_id.where(some, "0").astype("int64").to_numpy()
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for k in np.flatnonzero((low < high) & some):  # ids that are bounds themselves
            low[k] = bisect_right(bounds, (int(own[k]), digest.iloc[k]), int(low[k]), int(high[k]))
        return pd.Series(np.where(some, low, 0).astype(np.int32))

    return udf


def _fresh(spark: SparkSession, path: str) -> None:
    """Raise where ``path`` holds an archive; drop what a failed run left there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")):
        raise FileExistsError(f"{path} holds an archive")
    _drop_temporary(spark, path)


def _drop_temporary(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tmp")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` below ``path`` and return the committed manifest, one row per file."""
    spark = pages.sparkSession
    _fresh(spark, path)
    html = F.coalesce(F.col("html"), F.lit(""))
    none = lambda kind: F.lit(None).cast(kind)
    head = materialize(heads(pages), "warc_heads")
    bounds = shard_bounds(head, shard_bytes)
    plan = planned(head, min_bytes).select("page_id", "digest", F.lit(0).alias("kind"), "target", none("string").alias("url"), none("string").alias("html"))
    rows = pages.select("page_id", F.sha1(html).alias("digest"), F.lit(1).alias("kind"), none(LONG).alias("target"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    # a record's plan and its payload have one sort key, so they meet in the stream without a join of payloads
    # ids go to pandas as text: beside nulls it would make floats of them
    shard = shard_of(bounds)(F.col("page_id").cast("string"), "digest") if bounds else F.lit(0)
    ranged = plan.unionByName(rows).withColumn("shard", shard).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    ranged = ranged.select("shard", F.col("page_id").cast("string"), "kind", F.col("target").cast("string"), "url", "html")
    found = materialize(ranged.mapInPandas(_writer(path, roll_bytes), MANIFEST), "warc_manifest")
    moved = found.repartition(max(1, found.count()), "final").mapInPandas(_commit, MANIFEST)
    manifest = f"{path}/manifest"
    moved.write.parquet(manifest)
    _drop_temporary(spark, path)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _writer(path: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = _open(path)
        fs.create_dir(f"{root}/tmp", recursive=True)
        out, row, target, seq, last = None, {}, None, 0, None

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame([row | {"bytes": row["bytes"], "sha256": row.pop("hash").hexdigest()}])

        for batch in batches:
            for shard, page_id, kind, to, url, html in batch.itertuples(index=False):
                if shard != last and out is not None:
                    yield closed()
                    out = None
                seq, last = seq if shard == last else 0, shard
                if kind == 0:
                    target = None if pd.isna(to) else int(to)
                    continue
                member = gzip.compress(record(None if pd.isna(page_id) else int(page_id), url, html.encode(), target), 6, mtime=0)
                if out is None:
                    row = {"shard": shard, "seq": seq, "temporary": f"{path}/tmp/{shard:06d}-{seq:05d}.{attempt}", "final": f"{path}/shard-{shard:06d}-{seq:05d}.warc.gz", "records": 0, "bytes": 0, "hash": hashlib.sha256()}
                    out, seq = fs.open_output_stream(f"{root}/tmp/{shard:06d}-{seq:05d}.{attempt}"), seq + 1
                out.write(member)
                row["hash"].update(member)
                row["records"] += 1
                row["bytes"] += len(member)
                if row["bytes"] >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def _commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Move files to their final names; a task that is run again finds them moved."""
    for batch in batches:
        for row in batch.itertuples():
            fs, old = _open(row.temporary)
            _, new = _open(row.final)
            if fs.get_file_info(old).type != pafs.FileType.NotFound:
                fs.move(old, new)
        yield batch


def read_archive(manifest: DataFrame) -> DataFrame:
    """The records of an archive's files, streamed; payload digests are checked against the payloads."""
    return manifest.select("final").repartition(max(1, manifest.count()), "final").mapInPandas(_reader, RECORD)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        heads = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            heads[name] = value.strip()
        yield heads, stream.read(int(heads["Content-Length"]))


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"page_id": "Int64", "refers_to": "Int64"}
    for batch in batches:
        for path in batch["final"]:
            fs, name = _open(path)
            rows = []
            with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for heads, block in parse(stream):
                    digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                    if heads["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{path}: the payload of {heads['WARC-Record-ID']} does not match its digest")
                    number = lambda k: int(heads[k]) if heads.get(k) else None  # noqa: B023, E731
                    rows.append((number("X-Page-Id"), heads["WARC-Target-URI"], int(heads["X-Payload-Length"]), digest, heads["WARC-Type"], number("X-Refers-To-Page"), name.rpartition("/")[2]))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=columns).astype(kinds)
                        rows = []
            yield pd.DataFrame(rows, columns=columns).astype(kinds)


def roundtrip(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark: SparkSession = pages.sparkSession
    return read_archive(write_archive(pages, scratch_path(spark, "warc"), roll_bytes, min_bytes))
