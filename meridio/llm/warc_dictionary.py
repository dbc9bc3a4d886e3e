"""WARC archives with one Zstandard dictionary, embedded in a leading skippable frame.

The dictionary is built from a bounded sample of the records. Every file starts with a skippable
frame that holds it, and each record is a frame of its own, so a record can be read by its offset.
Of records with equal payloads of at least LEAST bytes, the one of the smallest page_id is a
response and the others are revisits that refer to it.

Files are written under a name of their own and then renamed, so a task that is run again, or runs
twice, leaves one whole file.

Defined results: a null html is an empty payload; payloads under LEAST bytes are all responses;
rows of a null page_id are responses with an empty id, read back as null; rows equal in page_id
and payload are both written, as responses if theirs is the smallest id; an empty table gives no
rows; other columns of the pages are not archived. Texts are written whole. Ids go through Python as
text, so that no long becomes a float beside a null.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridio.llm.common import file_system, new_path, small_batches

LEAST = 100
#: The sample for the dictionary: so many records at most, of so many bytes each at most.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 400, 1 << 16, 64 * 1024
SKIPPABLE = 0x184D2A5D
CHUNK = 1 << 20


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where the sample is too small for one, its bytes as they are."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[-DICTIONARY:]
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def coder(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=6, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)) if d else (zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor())


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    name = "" if page_id is None else str(page_id)
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, its payload checked against its digest where it holds one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    inner = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload differs from its digest")
    page, refers = inner(fields["WARC-Record-ID"]), inner(fields.get("WARC-Refers-To", ""))
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
        "url": fields["WARC-Target-URI"],
        "payload": body,
    }


def read_frames(stream):
    """The records of an archive, one frame at a time."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, length = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with its dictionary")
    _, reader = coder(stream.read(length))
    held = b""
    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not held:
                held = stream.read(CHUNK)
                if not held:
                    raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(held))
            held = frame.unused_data
        yield b"".join(parts)


def revisits(pages: DataFrame) -> DataFrame:
    """pages with __payload, __digest and __first: the smallest page_id of its payload, if that is shared."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("__payload")).withColumn("__digest", F.sha2("__payload", 256))
    shared = (
        rows.where(F.octet_length("__payload") >= LEAST)
        .groupBy("__digest")
        .agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
        .where(F.col("__n") > 1)
        .select("__digest", "__first")
    )
    return rows.join(shared, "__digest", "left")


def dictionary_sample(pages: DataFrame) -> list[bytes]:
    """The html of SAMPLE pages, the first by a hash of page_id. Ids are chosen first, so partitions send no html but theirs."""
    size = F.octet_length("html")
    fit = pages.where((size > 0) & (size <= SAMPLE_BYTES) & F.col("page_id").isNotNull())
    order = F.xxhash64(F.lit("dictionary"), "page_id")
    chosen = fit.select("page_id", order.alias("__order")).distinct().orderBy("__order", "page_id").limit(SAMPLE).select("page_id").collect()
    ids = pages.sparkSession.createDataFrame(chosen, pages.select("page_id").schema)  # SAMPLE rows at most
    found = fit.select("page_id", "html").join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    return [r.html.encode("utf-8", "replace") for r in sorted(found.collect(), key=lambda r: r.page_id)]


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write every page into archives under folder. Returns it and the list of files (file, records, bytes)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    dictionary = build_dictionary(dictionary_sample(pages))
    fs, at = file_system(spark, folder)
    fs.mkdirs(at)

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        draft = f"{root}/.{uuid.uuid4().hex}"
        writer, _ = coder(dictionary)
        n = size = 0
        with store.open_output_stream(draft, compression=None) as out:
            size += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary) or 0
            for batch in batches:
                for page, url, payload, digest, first in zip(batch["page_id"], batch["url"], batch["__payload"], batch["__digest"], batch["__first"], strict=True):
                    refers = None if first is None or page is None or first == page else first
                    frame = writer.compress(record(page, url, bytes(payload), digest, refers))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
        if n:
            store.move(draft, name)
            yield pd.DataFrame({"file": [name.rsplit("/", 1)[1]], "records": [n], "bytes": [size]})
        else:
            store.delete_file(draft)

    listed = f"{folder}-files"
    rows = revisits(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "__first")})
    rows.mapInPandas(write, "file string, records long, bytes long").write.parquet(listed)
    return folder, spark.read.schema("file string, records long, bytes long").parquet(listed)


def read_archives(folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives."""
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch["file"]:
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    held = []
                    for data in read_frames(stream):
                        row = parse(data)
                        held.append(row if payloads else row | {"payload": b""})
                        if len(held) >= 128:
                            yield frame_of(held)
                            held = []
                    if held:
                        yield frame_of(held)

    def frame_of(rows):
        import pandas as pd

        ids = {c: pd.array([r[c] for r in rows], dtype="Int64") for c in ("page_id", "refers_to")}
        return pd.DataFrame([{c: x for c, x in r.items() if c not in ids} for r in rows]).assign(**ids)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInPandas(read, fields)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    folder, files = write_archives(pages)
    return read_archives(folder, files, payloads=False).drop("payload")
