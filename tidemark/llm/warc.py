"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then a frame per record, each
with its content size and checksum. The reader loads the dictionary from the first frame, decodes frame
by frame in bounded memory, and validates record headers, block lengths, digests and the record's end.
Archives of other writers are read too: without a dictionary, with other record types (which are passed
over), and with HTTP messages as blocks.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches, written
from .exact_dedup import located
from .files import listed, new_file, stored_file, tasks

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000
#: Pages that the dictionary is trained on, about, pieces of each at most, spread over the whole page, bytes of a piece, and bytes of the dictionary.
DICT_PAGES, DICT_PIECES, DICT_PIECE, DICT_BYTES = 400, 4, 16_384, 65_536
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 18
#: Header names, which may come in any case.
NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Page-ID", "WARC-Refers-To", "WARC-Refers-To-Page-ID")}


class BrokenArchive(ValueError):
    """An archive whose frames, headers, lengths or digests are wrong."""


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ':' + key)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names as WARC spells them) and block of one record; raises BrokenArchive where it isn't exactly one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first not in (b"WARC/1.1", b"WARC/1.0") or not mark:
        raise BrokenArchive("a record has no WARC/1.0 or WARC/1.1 head")
    fields, last = {}, ""
    for line in lines:
        if last and line[:1] in b" \t" and line.strip():  # goes on with the line before
            fields[last] += " " + line.strip().decode("utf-8", "surrogatepass")
            continue
        k, colon, v = line.partition(b":")
        if not colon or not k.strip():
            raise BrokenArchive(f"a header line has no name: {line[:60]!r}")
        last = NAMES.get(k.strip().lower().decode("latin-1"), k.strip().decode("latin-1"))
        fields[last] = v.strip(b" \t").decode("utf-8", "surrogatepass")
    for need in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if need not in fields:
            raise BrokenArchive(f"a record has no {need}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BrokenArchive("a record's length isn't its Content-Length")
    return fields, rest[:-4]


def joined(head: bytes, f):
    """A reader of head and what follows in f."""
    first = io.BytesIO(head)
    return type("Joined", (), {"read": staticmethod(lambda n: first.read(n) or f.read(n))})


def frames(f) -> tuple[bytes, object]:
    """The dictionary of an open archive (empty where it has none), and an iterator over its records' bytes."""
    head = f.read(8)
    if head[:4] == FRAME:
        f, dictionary = joined(head, f), b""
    elif len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
        raise BrokenArchive("an archive begins neither with its dictionary's frame nor with a record")
    else:
        size = struct.unpack("<II", head)[1]
        dictionary = f.read(size)
        if len(dictionary) != size:
            raise BrokenArchive("an archive's dictionary is cut off")
    if dictionary.startswith(FRAME):  # it may be compressed itself
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)

    def records():
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        held = b""
        while True:
            if not held:
                held = f.read(READ)
                if not held:
                    return
            frame, out = decoder.decompressobj(), []
            while True:
                try:
                    out.append(frame.decompress(held))
                except zstandard.ZstdError as e:
                    raise BrokenArchive(f"a frame can't be decoded: {e}") from e
                held = frame.unused_data if frame.eof else b""
                if frame.eof:
                    break
                held = f.read(READ)
                if not held:
                    raise BrokenArchive("an archive ends inside a frame")
            yield b"".join(out)

    return dictionary, records()


def train_dictionary(pages: DataFrame, payload: Column, key: Column) -> bytes:
    """A dictionary from pieces of about DICT_PAGES pages by hash of key; where they are too few to train on, their first DICT_BYTES bytes themselves.

    The driver gets twice DICT_PAGES x DICT_PIECES x DICT_PIECE bytes (52 MB) at most, however long pages are.
    """
    every = max(1, pages.count() // DICT_PAGES)
    size, data = F.ceil(F.octet_length("p") / DICT_PIECE), F.col("p")
    count = F.least(size, F.lit(DICT_PIECES))
    spread = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, F.floor(i * size / count).cast("int") * DICT_PIECE + 1, F.lit(DICT_PIECE)))
    sample = pages.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(payload.cast("binary").alias("p"), F.xxhash64(key).alias("k")).where(F.octet_length("p") > 0)
    found = sample.select("k", spread.alias("pieces")).orderBy("k").limit(2 * DICT_PAGES).toLocalIterator()
    pieces = [bytes(p) for r in found for p in r["pieces"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        plain = b"".join(pieces)[:DICT_BYTES]
        return plain if len(plain) >= 8 else b""


def referents(rows: DataFrame, at: str) -> DataFrame:
    """at, refers_to for the rows (at, id, payload) of which another one, with the largest id, has the payload. Payloads themselves aren't shuffled."""
    key = ["digest", "size", "other"]
    narrow = rows.select(F.col(at), "id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("other")).where(F.col("size") >= REVISIT_FROM)
    narrow = written(narrow, "warc-digests")
    groups = narrow.groupBy(*key).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return written(narrow.join(groups, key).where(~F.col("keep").eqNullSafe(F.col("id"))).select(F.col(at), F.col("keep").alias("refers_to")), "warc-referents")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for every row of pages to archives in a folder of the shared file system.

    Of rows whose payloads (UTF-8; null is empty) are equal and have REVISIT_FROM bytes or more, that with
    the largest id is a response and the others revisit it; rows repeated with that very id are
    responses; null ids are responses or revisits too, and are no referents unless all are null. Null
    urls are left out. Records go by partition, in archives of about ARCHIVE_BYTES of payload; a
    very long page makes a large record. An empty table makes no archive. Other columns aren't read. A task
    that runs again writes archives under new names; `manifest`, a Parquet table in the folder, names those
    of the attempts that counted.
    """
    rows, at = located(text_batches(pages))
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = rows.select(F.col(f"`{at}`").alias("at"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    dictionary = train_dictionary(rows, F.col("payload"), F.col("id"))
    today = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archives(parts):
        encoder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        task, number, held, done = TaskContext.get(), 0, None, []
        size = 0
        for pdf in parts:
            for own, url, payload, refers in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["refers_to"]):
                if held is None:
                    name, size = f"{folder}/pages-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.warc.zst", 0
                    held = new_file(name)
                    out = held.__enter__()
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                    number += 1
                own = own or ""
                fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id("page", own)), ("WARC-Date", today), ("WARC-Page-ID", own)]
                if url is not None:
                    fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
                fields += [("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("WARC-Payload-Length", str(len(payload)))]
                if refers:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("page", refers)), ("WARC-Refers-To-Page-ID", refers)]
                out.write(encoder.compress(record(fields, b"" if refers else payload)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    held.__exit__(None, None, None)
                    done.append(name)
                    held = None
        if held is not None:
            held.__exit__(None, None, None)
            done.append(name)
        if done:
            yield pd.DataFrame({"archive": done})

    # ids travel as text: a number beside a null would become a float on the way
    ready = rows.join(referents(rows, "at"), "at", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    ready.mapInPandas(archives, "archive string").write.parquet(f"{folder}/manifest")


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder: those of its manifest, or, where another writer left none, all."""
    try:
        return spark.read.schema("archive string").parquet(f"{folder}/manifest")
    except AnalysisException:
        return spark.createDataFrame([(n,) for n in listed(spark, folder, ".warc.zst")], "archive string")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit of a folder's archives: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, and with payloads the payload (null for revisits).

    page_id and refers_to are null, and the length of a revisit's payload -1, where another writer doesn't
    say them; records of other types are passed over. Repeated records each get a row; very long ones are
    read whole; a folder without archives gives an empty result. Raises BrokenArchive for records whose
    headers, lengths or digests are wrong.
    """
    files = archives_of(spark, folder)
    files = files.repartition(tasks(files.count()))
    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=columns, dtype=object)
        for c in ("page_id", "refers_to"):
            pdf[c] = pd.array(pdf[c].tolist(), dtype="Int64")
        return pdf

    def read(parts):
        for pdf in parts:
            for name in pdf["archive"]:
                with stored_file(name) as f:
                    rows, held = [], 0
                    for data in frames(f)[1]:
                        row = row_of(*parse(data))
                        if row is None:
                            continue
                        rows.append(row if payloads else row[:-1])
                        held += len(data) if payloads else 1
                        if held > (1 << 23 if payloads else 20_000):
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    kinds = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint" + ", payload binary" * payloads
    return files.mapInPandas(read, kinds)


def row_of(fields: dict[str, str], block: bytes) -> tuple | None:
    """A record's row, the payload last; None if it is neither a response nor a revisit."""
    kind, size = fields["WARC-Type"], int(fields.get("WARC-Payload-Length") or -1)
    if kind not in ("response", "revisit"):
        return None
    digest = sha1_of(fields.get("WARC-Payload-Digest", ""))
    payload, own = block, "WARC-Page-ID" in fields
    if fields.get("Content-Type", "").replace(" ", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if digest not in (None, found) or size not in (-1, len(payload)) or own and digest is None:
            raise BrokenArchive("a payload doesn't have its digest or length")
        digest, size = found, len(payload)
    elif payload or own and "WARC-Refers-To" not in fields:
        raise BrokenArchive("a revisit record has a payload or no referent")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("WARC-Page-ID"), fields.get("WARC-Target-URI"), kind, number("WARC-Refers-To-Page-ID"), digest, size, payload if kind == "response" else None


def sha1_of(digest: str) -> str | None:
    """A labelled SHA-1, in hexadecimal or base 32, as lower-case hexadecimal; None if it is no SHA-1."""
    name, _, value = digest.partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex() if len(value) == 32 else None
