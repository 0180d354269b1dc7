"""Operator 3: media columns. Magic bytes are located by Aho-Corasick, and validators confirm structure and length."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Found(NamedTuple):
    media_type: str
    offset: int
    length: int


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big") or (p == at + 8) != (kind == b"IHDR"):
            return 0
        if kind == b"IEND":
            return end - at
        p = end
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    packed = b[at + 10]
    p = at + 13 + (3 << (packed & 7) + 1 if packed & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, size = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return 0
        p += 2 + size
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7 and b[p + 1] != 0xFF:
                    break  # a marker segment between scans
                p += 2 if b[p + 1] != 0xFF else 1
            if p < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, reserved, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    rows = -(-abs(width) * bits // 32) * 4 * abs(height)
    good = reserved == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and start >= 14 + header
    compression = struct.unpack_from("<I", b, at + 30)[0]
    return size if good and at + size <= len(b) and (compression or start + rows <= size) else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    if end > len(b):
        return 0
    seen = []
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, p)
        seen.append(kind)
        p += 8 + size + (size & 1)
    need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}, b"WEBP": set()}[b[at + 8 : at + 12]]
    return end - at if seen and p == end and need <= set(seen) else 0


def _gzip(b: bytes, at: int) -> int:
    d, total = zlib.decompressobj(31), 0
    try:
        rest = b[at:]
        while rest and not d.eof:
            total += len(d.decompress(rest, 1 << 20))  # the size is checked without holding the content
            rest = d.unconsumed_tail
    except zlib.error:
        return 0
    return len(b) - at - len(d.unused_data) - len(rest) if d.eof else 0


def _zip(b: bytes, at: int) -> int:
    p, end = at, at
    while (p := b.find(b"PK\x05\x06", p)) >= 0 and p + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if at + start + size == p and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            end = p + 22 + note
            return end - at if end <= len(b) else 0
        p += 4
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    nxt = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, nxt if nxt >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def _flac(b: bytes, at: int) -> int:
    p, last, first = at + 4, False, True
    while not last:
        if p + 4 > len(b):
            return 0
        last, kind, size = bool(b[p] & 0x80), b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind or size != 34):
            return 0
        first, p = False, p + 4 + size
    # frames have no length of their own: the stream goes on to the end
    return len(b) - at if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0


def _ogg(b: bytes, at: int) -> int:
    p, end = at, 0
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return 0
        p += size
        if b[p - size + 5] & 4:
            return p - at
        end = p - at
    return end


def _mp4(b: bytes, at: int) -> int:
    p, seen = at - 4, set()
    if p < 0:
        return 0
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if size == 1 and p + 16 <= len(b):
            size = struct.unpack_from(">Q", b, p + 8)[0]
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        p += size
    return p - at + 4 if seen >= {b"ftyp", b"moov"} else 0


#: Magic bytes, media type, validator (the length from the beginning of the magic, 0 if it is none), bytes before the magic.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], int], int]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"RIFF", "", _riff, 0),
    (b"\x1f\x8b\x08", "application/gzip", _gzip, 0),
    (b"PK\x03\x04", "application/zip", _zip, 0),
    (b"%PDF-", "application/pdf", _pdf, 0),
    (b"fLaC", "audio/flac", _flac, 0),
    (b"OggS", "audio/ogg", _ogg, 0),
    (b"ftyp", "video/mp4", _mp4, 4),
]
_RIFF = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(data: bytes, a=None) -> list[Found]:
    """The media in the bytes, outermost first and without what lies in one found before, in order of offset."""
    out, clear = [], 0
    for end, k in (a or automaton()).iter(data.decode("latin-1")):
        magic, kind, length, before = SIGNATURES[k]
        at = end + 1 - len(magic)
        if at - before < clear:
            continue
        if magic == b"RIFF":
            kind = _RIFF.get(data[at + 8 : at + 12], "")
        if kind and (n := length(data, at)):
            out.append(Found(kind, at - before, n + before if magic != b"ftyp" else n))
            clear = out[-1].offset + out[-1].length
    return out


def corrected(declared: str | None, found: list[Found], size: int) -> str:
    """The type of the whole: of a medium at offset 0, else the declared one if the bytes can't contradict it."""
    if found and found[0].offset == 0:
        return found[0].media_type
    known = {kind for _, kind, *_ in SIGNATURES} | set(_RIFF.values())
    return declared if declared and declared not in known and size else "application/octet-stream"


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit unsigned mono PCM; the samples must be an even number of bytes."""
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(samples)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), samples))


def wav_samples(data: bytes) -> bytes:
    """The samples of a stored WAV, carved by its chunks; ValueError if it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE" or _riff(data, 0) != len(data):
        raise ValueError("no WAV")
    p = 12
    while p + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, p)
        if kind == b"data":
            return data[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no samples")


def sniff_media(media: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """Adds media_type (corrected), type_was_wrong and embedded (array of type, offset, length, carved bytes' sha256, bytes).

    A null content has a null type and no embedded media; empty content is application/octet-stream.
    Columns of these names are replaced; all others, repeated rows included, stay.
    """
    schema = "struct<media_type string, embedded array<struct<media_type string, offset long, length long, sha256 string, bytes binary>>>"

    @F.pandas_udf(schema)
    def look(content, declared):
        import pandas as pd

        a, out = automaton(), []
        for data, said in zip(content, declared):
            if data is None:
                out.append((None, []))
                continue
            found = sniff(data, a)
            parts = [(m.media_type, m.offset, m.length, hashlib.sha256(x := data[m.offset : m.offset + m.length]).hexdigest(), x) for m in found if m.offset or m.length < len(data)]
            out.append((corrected(said, found, len(data)), parts))
        return pd.DataFrame(out, columns=["media_type", "embedded"])

    keep = [c for c in media.columns if c not in ("media_type", "type_was_wrong", "embedded")]
    seen = media.select(*keep, look(content, declared).alias("__seen"))
    return seen.select(*keep, F.col("__seen.media_type").alias("media_type"), (~F.col("__seen.media_type").eqNullSafe(F.col(declared))).alias("type_was_wrong"), F.col("__seen.embedded").alias("embedded"))


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, stored): each text's UTF-8, zero-padded to a positive multiple of 64, as the samples of a WAV."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                raw = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column(1)]
                stored = [wav(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "stored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, n_bytes long, stored binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Of stored media with any declared type: what the bytes are, and checksums of the samples read back.

    feature is the corrected type, the samples' length, and the media that lie in the samples (type@offset+length).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, names = automaton(), ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(batch.column(k) for k in range(3))):
                data = data.as_py()
                found = sniff(data, a)
                kind = corrected("application/octet-stream", found, len(data))
                samples = wav_samples(data)
                inside = ",".join(f"{m.media_type}@{m.offset}+{m.length}" for m in sniff(samples, a))
                rows.append((doc.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{kind};{len(samples)};{inside}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return stored.select("doc_id", "n_bytes", "stored").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Texts stored as media and read back; see store_payloads and media_features.

    Null and empty text: 64 zero bytes. Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    return media_features(Scratch(docs.sparkSession, "media").table(store_payloads(docs), "stored"))
