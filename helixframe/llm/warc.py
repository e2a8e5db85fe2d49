"""WARC archives: a deterministic sharded writer, and a reader.

Records are dealt to shards by ranges of page_id, cut where the bytes of all pages before add up to a shard's, and sorted
within them. Each shard rolls to a new file once the compressed size is reached. Headers and digests are made anew from the payloads; a
payload that an earlier record has becomes a revisit. Tasks write under temporary names, their rows make the manifest,
and only the files that it names are renamed; so a lost or repeated task leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Uncompressed bytes of a shard, compressed bytes at which a file is closed, tasks that write shards or read files.
SHARD_BYTES, ROLL_BYTES, MOST_TASKS = 32 << 20, 16 << 20, 100_000
#: A payload of more pages than this, and than a thousandth of all, is a common one; there are fewer than 1000 of them.
COMMON_PAGES = 10_000
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
LEVEL, DATE = 4, "2024-01-01T00:00:00Z"
MANIFEST = "file string, temporary string, shard int, records long, bytes long, sha256 string, first_page long, last_page long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record of the payload, or with ``refers_to`` a revisit of that page's record."""
    digest = hashlib.sha256(payload).hexdigest()
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, http if refers_to is not None else http + payload)


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _written(out: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(out)
        done, now, shard, number = [], None, None, 0

        def close() -> None:
            nonlocal now
            if now:
                now["stream"].close()
                done.append((now["file"], now["temporary"], shard, now["records"], now["bytes"], now["sha"].hexdigest(), now["first"], now["last"]))
                now = None

        def put(data: bytes) -> None:
            now["stream"].write(data)
            now["sha"].update(data)
            now["bytes"] += len(data)

        first_of: dict[str, int] = {}  # the markers of the page that comes next: digest to page
        page = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, number = row["shard"], 0
                if row["page_id"] != page:
                    page, first_of = row["page_id"], {}
                if row["refers_to"] is not None:
                    first_of[row["digest"]] = row["refers_to"]
                    continue
                if now is None:
                    name = f"part-{shard:05d}-{number:05d}.warc.gz"
                    temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
                    now = {"file": name, "temporary": temporary, "stream": files.open_output_stream(f"{root}/{temporary}", compression=None), "sha": hashlib.sha256(), "bytes": 0, "records": 0, "first": row["page_id"], "last": None}
                    number += 1
                    put(_gzip(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                payload = (row["html"] or "").encode()
                put(_gzip(page_record(row["page_id"], row["url"], payload, first_of.get(row["digest"]))))
                now["records"] += 1
                now["last"] = row["page_id"]
                if now["bytes"] >= roll:
                    close()
        close()
        if done:
            columns = zip(*done, strict=True)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "temporary", "shard", "records", "bytes", "sha256", "first_page", "last_page"])

    return run


def _renamed(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = _filesystem(out)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist(), strict=True):
                there = files.get_file_info(f"{root}/{temporary}").type == fs.FileType.File
                if there:  # else an earlier try of this task has renamed it
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    return run


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows in order of page_id: the bytes of its smaller pages, and its number."""
    part, total, page, at_page = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        inner = []
        for p, n in zip(batch.column("page_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if p != page:
                page, at_page = p, total
            inner.append(at_page)
            total += n
        columns = [batch.column("page_id"), batch.column("bytes"), pa.array(inner, pa.int64()), pa.array([part] * batch.num_rows, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "bytes", "inner", "part"])


def _shard_bounds(light: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first page_id of each shard: a page is in the shard in which the bytes of all smaller pages end.

    The same for the same rows, however they are dealt. A shard is one number here, and 32 MiB or more of pages.
    """
    ranged = light.filter("page_id is not null").select("page_id", "bytes").repartitionByRange("page_id").sortWithinPartitions("page_id")
    rows = materialize(ranged.mapInArrow(_before, "page_id long, bytes long, inner long, part int"), "sizes")
    sums = rows.groupBy("part").agg(F.sum("bytes").alias("all"))  # one row for each task
    sums = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    shard = ((F.col("inner") + F.col("before")) / max(shard_bytes, 1)).cast("long").alias("shard")
    found = rows.join(sums, "part").groupBy(shard).agg(F.min("page_id").alias("first")).orderBy("first").collect()
    drop_materialized(rows)
    return np.array([r["first"] for r in found], np.int64)


def _revisits(light: DataFrame, least_revisit: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller page has.

    Pages of common payloads meet their first page without a shuffle, as there are few such payloads, so that no task
    gets all pages of one.
    """
    large = light.filter((F.col("bytes") >= least_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("pages"))
    groups = materialize(groups.filter("last > refers_to").drop("last"), "firsts")
    common = F.col("pages") > max(COMMON_PAGES, (groups.agg(F.sum("pages")).first()[0] or 0) // 1000)
    few = F.broadcast(groups.filter(common).drop("pages"))
    others = large.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~common).drop("pages"), "digest")
    return large.join(few, "digest").unionByName(others).filter("page_id > refers_to").distinct()


def write_warc(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id long, url, html) to the folder ``out`` and return the manifest, also kept in ``out``.

    Of rows with equal payloads of at least ``least_revisit`` bytes the one with the smallest page_id is a response and
    the others revisit it. Null html counts as empty, a null url gets a urn; rows that repeat a page_id and its payload
    are alike in type and share a shard; rows without page_id are written as responses, in shards of their own by a hash
    of url and payload. Payloads of any length are written whole. Other columns are left aside. No rows give no file.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    page = F.col("page_id").cast("long").alias("page_id")
    light = materialize(pages.select(page, F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest")), "digests")
    bounds = _shard_bounds(light, shard_bytes)
    nameless = light.filter("page_id is null").agg(F.sum("bytes")).first()[0] or 0
    shards, spare = max(len(bounds), 1), 1 + nameless // max(shard_bytes, 1)

    @F.pandas_udf("int")
    def shard_of(page: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds, page.fillna(-1).to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    none = F.lit(None).cast("string")
    revisits = _revisits(light, least_revisit).select("page_id", none.alias("url"), none.alias("html"), "digest", "refers_to")
    records = pages.select(page, "url", "html", F.sha2(html, 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    # pages without id have shards of their own, after the others
    shard = F.when(F.col("page_id").isNull(), shards + F.pmod(F.xxhash64("digest", "url"), F.lit(spare)).cast("int")).otherwise(shard_of(F.coalesce("page_id", F.lit(0))))
    # a page's revisit markers (those with refers_to) come just before it
    # beyond so many tasks, a task writes several neighbouring shards
    tasks = min(shards + spare, MOST_TASKS)
    task = (F.col("shard").cast("long") * tasks / (shards + spare)).cast("int")
    rows = records.unionByName(revisits).withColumn("shard", shard).repartitionById(tasks, task).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), F.col("refers_to").asc_nulls_last(), "digest", "url")
    files, root = _filesystem(out)
    files.create_dir(f"{root}/_temporary", recursive=True)
    rows.mapInArrow(_written(out, roll_bytes), MANIFEST).write.parquet(f"{out}/_written")
    written = spark.read.schema(MANIFEST).parquet(f"{out}/_written")
    written.mapInArrow(_renamed(out), MANIFEST).write.parquet(f"{out}/_manifest")
    files.delete_dir(f"{root}/_temporary")
    files.delete_dir(f"{root}/_written")
    return spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def _members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of a file."""
    at = 0
    while at < len(data):
        made, parts = zlib.decompressobj(31), []
        while not made.eof and at < len(data):
            chunk = data[at : at + 32768]
            parts.append(made.decompress(chunk))
            at += len(chunk) - len(made.unused_data)
        if not made.eof:
            raise ValueError("a WARC file ends inside a record")
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or block digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    block = rest[:n]
    if lines[0] != "WARC/1.1" or len(block) != n or rest[n:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def _rows(content: bytes) -> list[tuple]:
    """The responses and revisits of a file."""
    rows = []
    for data in _members(memoryview(content)):
        headers, block = parse_record(data)
        if headers["WARC-Type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
        page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
        rows.append((page and int(page), size, digest, headers["WARC-Type"], refers and int(refers), headers["WARC-Target-URI"], headers["WARC-Record-ID"], payload if headers["WARC-Type"] == "response" else None))
    return rows


def _parsed(path: str):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(path)
        for batch in batches:
            for name, n, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "sha256")), strict=True):
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    content = stream.read()
                if len(content) != n or hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"{name} is not what the manifest says")
                if rows := _rows(content):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response or revisit of the archives that the manifest in ``path`` names, and of no others.

    Without a manifest nothing was committed, and reading fails; so does a file that isn't there or isn't as the manifest
    says, or a damaged record. Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id,
    payload (revisits: null).
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary"
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    # a task for each file
    return manifest.select("file", "bytes", "sha256").repartition(max(1, min(manifest.count(), MOST_TASKS))).mapInArrow(_parsed(path), schema)
