"""Deterministic sharded WARC files, and a reader.

Records are range-sorted by key into shards whose bounds follow from the data
alone. A task writes its shard's records in order, each a gzip member, and
starts a new file once the compressed size is reached. Files are written under
temporary names and moved into place; the manifest, committed by Spark's own
writer, names those that count. Every attempt of a task writes the same bytes.

Defined cases: a null payload is empty; null keys sort first, their records
carry no key and are never referred to; rows of one key, or of the null key, of
more bytes than a shard are dealt over several by their payloads' hash; equal payloads of at least ``dedup_bytes``
have one response, that of the largest key (rows that repeat this key too), and
revisits; texts of any size are one record; no rows give an empty manifest;
further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.llm.common import bounded, stored

DEDUP_BYTES = 1000
SHARD_BYTES = 32 << 20
#: Ranges of equal size; beyond them shards grow with the data.
SHARDS = 1 << 15
ROLL_BYTES = 8 << 20
#: Copies of a payload are joined to their response over so many salts.
SALTS = 16
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "shard long, file string, records long, bytes long, digest string"


def _plan(sized: DataFrame, target: int) -> tuple[list[int], list[int]]:
    """The keys at which ranges begin, after that of the null key, and the number
    of shards of each range. Ranges follow from running sums of bytes in order of
    key; a key that holds more than ``target`` bytes is a range of several shards."""
    no_key = F.col("key").isNull()
    total, unkeyed, rows = sized.agg(F.sum("bytes"), F.sum(F.when(no_key, F.col("bytes"))), F.count_if(no_key)).first()
    target = max(target, -(-(total or 0) // SHARDS))
    ranged = sized.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).repartitionByRange("key")
    keys = stored(ranged.withColumn("part", F.spark_partition_id()), "warc-sizes")
    # One row a partition, so neither the window nor the broadcast grows with the keys.
    earlier = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    ahead = keys.groupBy("part").agg(F.sum("bytes").alias("held")).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ahead"))
    within = W.Window.partitionBy("part").orderBy("key").rowsBetween(W.Window.unboundedPreceding, -1)
    summed = keys.join(F.broadcast(ahead), "part").withColumn("before", F.coalesce(F.sum("bytes").over(within), F.lit(0)) + F.col("ahead"))
    cuts = summed.groupBy(F.expr(f"before div {target}").alias("cut")).agg(F.min("key").alias("key")).select("key", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("rows"))
    found = cuts.unionByName(keys.where(F.col("bytes") > target).select("key", "bytes", "rows")).collect()  # up to 2 * SHARDS rows
    heavy = {r["key"]: (r["bytes"], r["rows"]) for r in found if r["bytes"]}
    starts = sorted({r["key"] for r in found} | {k + 1 for k in heavy if k < np.iinfo(np.int64).max})
    # No more shards than rows: a record isn't split.
    return starts, [max(1, min(n, -(-size // target))) for size, n in [(unkeyed or 0, rows), *(heavy.get(k, (0, 0)) for k in starts)]]


def _member(lines: list[str], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def _record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = "unknown" if key is None else str(key)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}"]
    return _member(lines, block)


class _Shard:
    """The files of one shard, in the making."""

    def __init__(self, out: str, shard: int, roll: int):
        self.fs, self.path = pafs.FileSystem.from_uri(out)
        self.shard, self.roll, self.number, self.done = shard, roll, 0, []
        self.stream = None

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self.name = f"pages-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temporary, compression=None)
            self.records = self.bytes = 0
            self.digest = hashlib.sha1()
            self._write(_member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{self.name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {self.name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n"))
        self._write(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            final = f"{self.path}/{self.name}"
            try:
                self.fs.move(self.temporary, final)
            except OSError:  # another attempt moved its equal file first
                if self.fs.get_file_info(final).size != self.bytes:
                    raise
            self.done.append((self.shard, self.name, self.records, self.bytes, self.digest.hexdigest()))
            self.stream, self.number = None, self.number + 1


def references(keyed: DataFrame, dedup_bytes: int) -> DataFrame:
    """Key, content hash and ``refers_to`` of the rows that repeat a payload,
    without those of its largest key. ``keyed`` has key, content, bytes, mix."""
    large = keyed.where(F.col("bytes") >= dedup_bytes)
    groups = large.groupBy("content").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    salted = large.withColumn("salt", (F.abs(F.xxhash64("key")) % SALTS).cast("int"))
    return salted.join(groups, ["content", "salt"]).where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "content", "mix", "refers_to").distinct()


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", dedup_bytes: int = DEDUP_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives below ``out`` (a URI) and return the committed manifest."""
    spark = pages.sparkSession
    rows = bounded(pages).select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    keyed = stored(rows.select("key", F.unhex(F.sha2("payload", 256)).alias("content"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("mix")), "warc-keys")
    refs = references(keyed, dedup_bytes)
    starts, subs = _plan(keyed, shard_bytes)
    begins, parts = np.array(starts, np.int64), np.array(subs, np.int64)
    firsts = np.r_[0, np.cumsum(parts)]

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, unkeyed: pd.Series, mix: pd.Series) -> pd.Series:
        i = np.where(unkeyed.to_numpy(), 0, np.searchsorted(begins, keys.to_numpy(), "right"))
        return pd.Series((firsts[i] + mix.to_numpy() % parts[i]).astype("int32"))

    light = refs.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "mix", "content", "refers_to")
    both = rows.withColumns({"mix": F.xxhash64("payload"), "content": F.lit(None).cast("binary"), "refers_to": F.lit(None).cast("long")}).unionByName(light)
    shard = shard_of(F.coalesce("key", F.lit(0).cast("long")), F.col("key").isNull(), "mix")
    sharded = both.withColumn("shard", shard).drop("mix").repartitionById(int(firsts[-1]), "shard")
    ordered = sharded.sortWithinPartitions("key", F.col("refers_to").isNull(), "url", "payload")
    fs, path = pafs.FileSystem.from_uri(out)
    fs.create_dir(f"{path}/_temporary", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        current, known = object(), {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "payload", "content", "refers_to", "shard")]
            for k, u, data, content, refers, shard in zip(*columns, strict=True):
                if k != current:
                    current, known = k, {}
                if refers is not None:
                    known[content] = refers
                    continue
                files = files or _Shard(out, shard, roll_bytes)
                files.add(_record(k, u, data, known.get(hashlib.sha256(data).digest()) if known else None))
        if files:
            files.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files.done, strict=True)], ["shard", "file", "records", "bytes", "digest"])

    ordered.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{out}/_manifest")
    fs.delete_dir(f"{path}/_temporary")
    return spark.read.schema(_MANIFEST).parquet(f"{out}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an open archive."""
    pending = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(unpack.decompress(pending))
            pending = unpack.unused_data if unpack.eof else b""
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _page(uri: str | None) -> int | None:
    name = uri[len("<urn:page:") : -1] if uri else "unknown"
    return None if name == "unknown" else int(name)


def read(spark: SparkSession, out: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the manifest's files; digests are checked on the way."""
    if manifest is None:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{out}/_manifest")
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(out)
        names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if _sha1(block) != headers["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        http, _, data = block.partition(b"\r\n\r\n")
                        revisit = headers["WARC-Type"] == "revisit"
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if not revisit and (_sha1(data) != headers["WARC-Payload-Digest"] or len(data) != size):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), size, digest, None if revisit else data))
                        held += len(data)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return manifest.select("file").repartition(files).mapInArrow(run, schema)
