"""Media columns: bytes kept in Ogg files, one file a row, written and read by our own page code.

Container (RFC 3533). A page has the capture pattern, version, flags (1 continued, 2 first, 4 last), a 64-bit
granule position, stream serial, page number, checksum and up to 255 lacing values; a packet ends at a
lacing value under 255. Two logical streams are multiplexed: the samples (unsigned 8 bits, RATE a second;
granule: samples ended so far) and marks (one packet a second of samples with its position and a crc32;
same granules, so that the streams stay in step). Each stream starts with a header packet on a page of
its own; the samples' header holds rate and unpadded length.

The reader verifies every page's checksum and number, reassembles packets from lacing values across pages,
keeps streams apart by serial, knows each by its first packet, and derives the times of pages and of the marked
seconds from granules. A broken file raises ValueError; in a table it is a row with `error` and nothing else.

Cases. A null text is empty; an empty payload is 64 zero bytes. Everything in a file follows from the
payload, so equal texts give equal files. Rows with a null doc_id and repeated rows are kept. An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import materialize, table

RATE = 8000
PACKET = 4000
SAMPLES, MARKS = 1, 2
_HEADER = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, most significant bit first, no inversion).

    zlib has the mirrored one: with each byte and the result mirrored, and its inversions undone, both agree.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    made = head + body
    return made[:22] + struct.pack("<I", checksum(made)) + made[26:]


class Writer:
    """Packs one stream's packets into pages; a packet may go on over pages."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> list[bytes]:
        """packets: (bytes, granule at its end). A page on which no packet ends has granule -1."""
        laced: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, granule or -1
        for body, granule in packets:
            whole, rest = divmod(len(body), 255)
            laced += [(255, body[k * 255 : k * 255 + 255], -1) for k in range(whole)]
            laced.append((rest, body[whole * 255 :], granule))
        out, inside = [], False
        for lo in range(0, len(laced), 255):
            part = laced[lo : lo + 255]
            ended = [g for _, _, g in part if g >= 0]
            flags = inside * 1 + (first and not lo) * 2 + (last and lo + 255 >= len(laced)) * 4
            lacing, body = bytes(v for v, _, _ in part), b"".join(b for _, b, _ in part)
            out.append(page(self.serial, self.number, ended[-1] if ended else -1, flags, lacing, body))
            self.number += 1
            inside = part[-1][0] == 255
        return out


def store(payload: bytes, length: int) -> bytes:
    """An Ogg file with the payload's bytes as samples; length is what of them is not padding."""
    samples, marks = Writer(SAMPLES), Writer(MARKS)
    out = samples.pages([(b"\x01pcm8" + struct.pack("<IQQ", RATE, length, len(payload)), 0)], first=True)
    out += marks.pages([(b"\x01mark" + struct.pack("<I", RATE), 0)], first=True)
    for lo in range(0, len(payload), RATE):
        second = payload[lo : lo + RATE]
        last = lo + RATE >= len(payload)
        parts = [(second[k : k + PACKET], lo + min(k + PACKET, len(second))) for k in range(0, len(second), PACKET)]
        out += samples.pages(parts, last=last)
        out += marks.pages([(struct.pack("<QI", lo, zlib.crc32(second)), lo + len(second))], last=last)
    return b"".join(out)


def streams(media: bytes) -> dict[int, dict]:
    """Logical streams by serial: packets, end (granule of the last finished packet), pages, first and last flags, and
    spans: for each page that ends packets the granules before and after it and how many packets end.
    """
    found: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError(f"cut-off page at {at}")
        pattern, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        if pattern != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = media[at:end]
        if len(lacing) < n or len(whole) < end - at or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise ValueError(f"wrong checksum at {at}")
        s = found.setdefault(serial, {"packets": [], "open": b"", "end": 0, "pages": 0, "first": bool(flags & 2), "last": False, "spans": []})
        if number != s["pages"] or bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        s["pages"] += 1
        before = len(s["packets"])
        body, parts = at + 27 + n, [s["open"]]
        for value in lacing:
            parts.append(media[body : body + value])
            body += value
            if value < 255:
                s["packets"].append(b"".join(parts))
                parts = []
        s["open"] = b"".join(parts)
        if granule >= 0:
            if granule < s["end"]:
                raise ValueError(f"time runs back in stream {serial}")
            s["spans"].append((s["end"], granule, len(s["packets"]) - before))
            s["end"] = granule
        s["last"] = bool(flags & 4)
        at = end
    if any(s["open"] or not s["last"] for s in found.values()):
        raise ValueError("a stream has no end")
    return found


def _known(found: dict[int, dict], magic: bytes) -> dict:
    """The one stream whose first packet begins with the magic."""
    mine = [s for s in found.values() if s["first"] and s["packets"] and s["packets"][0].startswith(magic)]
    if len(mine) != 1:
        raise ValueError(f"{len(mine)} streams begin with {magic!r}")
    return mine[0]


def load(media: bytes) -> dict:
    """payload, length and what the granules tell: n_pages, n_streams, n_packets, seconds, and times (start and end of
    each marked second).
    """
    found = streams(media)
    samples, marks = _known(found, b"\x01pcm8"), _known(found, b"\x01mark")
    head, *parts = samples["packets"]
    if len(head) != 25:
        raise ValueError("the samples' header is damaged")
    rate, length, size = struct.unpack("<IQQ", head[5:])
    payload = b"".join(parts)
    if not rate or len(payload) != size or samples["end"] != size or marks["end"] != size:
        raise ValueError("granules and samples differ")
    times = []
    # a mark ends its page, so the page's granules are the second's
    for mark, (begin, end, ended) in zip(marks["packets"][1:], marks["spans"][1:], strict=True):
        if len(mark) != 12 or ended != 1:
            raise ValueError("a mark is damaged")
        place, crc = struct.unpack("<QI", mark)
        if place != begin or zlib.crc32(payload[begin:end]) != crc:
            raise ValueError(f"second at {place} is damaged")
        times.append((begin / rate, end / rate))
    return {
        "payload": payload, "length": length, "seconds": samples["end"] / rate, "rate": rate, "times": times, "n_streams": len(found),
        "n_pages": sum(s["pages"] for s in found.values()), "n_packets": sum(len(s["packets"]) for s in found.values()),
    }


def feature(payload: bytes, info: dict) -> str:
    """Duration, level and crossings of the signal, and its loudest second, as text."""
    x = np.frombuffer(payload, dtype=np.uint8)
    signal = x.astype(np.float64) - 128
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    rms = float(np.sqrt(np.mean(signal * signal)))
    starts = np.array([round(a * info["rate"]) for a, _ in info["times"]])
    power = np.add.reduceat(signal * signal, starts) / np.diff(np.r_[starts, len(x)])
    loud = info["times"][int(np.argmax(power))]
    return (
        f"seconds={info['seconds']:.6f};rms={rms:.4f};crossings={crossings};loudest={loud[0]:.6f}-{loud[1]:.6f};"
        f"pages={info['n_pages']};packets={info['n_packets']};streams={info['n_streams']}"
    )


def attach(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `media`: the column's text as UTF-8, padded with zeros to a positive multiple of 64, in Ogg."""

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bytes:
            raw = (text or "").encode("utf-8")
            return store(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw))

        return texts.map(one)

    return docs.withColumn("media", media(F.coalesce(F.col(column), F.lit(""))))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(rows: DataFrame) -> DataFrame:
    """Reads the media column back; one row each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, media in zip(batch["doc_id"], batch["media"]):
                media, key = bytes(media or b""), None if pd.isna(doc) else int(doc)
                try:
                    info = load(media)
                except ValueError as e:
                    out.append((key, None, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e)))
                    continue
                payload = info["payload"]
                out.append((
                    key, info["length"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(payload, info), None,
                ))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield frame.astype({c: "Int64" for c in ("doc_id", "n_bytes", "payload_bytes", "tail_crc32")})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInPandas(read, SCHEMA)


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(attach(table(spark, sf_dir, "documents")).select("doc_id", "media"), "ogg")
    return features(stored)
