"""MPEG audio columns: resynchronised frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

`parse` reads an MPEG 1/2/2.5 stream of layers I-III without decoding it; frames of free format (bitrate index 0), whose
length no header tells, are skipped and counted as bytes that are no frame. `carry` writes a valid
stream: layer III, mono, 32 kHz, variable bitrate, silent granules, and the payload as ancillary
bytes of the frames, behind an ID3v2 tag and a Xing/Info frame.

Edge cases: a null or empty stream has no frames, zero duration and sync_errors 0; bytes that are
no frame are skipped and counted; a truncated last frame is not counted as a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG 1?, layer), Hz by version bits, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# Fixed values of the same standards, layer II: (bits, subbands) of the bit allocation, by bitrate a channel and sample rate.
ALLOCATION = {
    "middle": ((4, 11), (3, 12), (2, 4)),
    "wide": ((4, 11), (3, 12), (2, 7)),
    "narrow": ((4, 2), (3, 6)),
    "narrow, 32 kHz": ((4, 2), (3, 10)),
    "half rate": ((4, 4), (3, 7), (2, 19)),
}

UNIT = 192
_OVERHEAD = 4 + 2 + 17  # header, checksum, side information of one channel
_SIZES = [(i, 144 * k * 1000 // 32000) for i, k in enumerate(BITRATES[True, 3]) if k]
_LARGEST = _SIZES[-1]


def _table(poly: int, reflected: bool) -> list[int]:
    out = []
    for x in range(256):
        c = x if reflected else x << 8
        for _ in range(8):
            if reflected:
                c = c >> 1 ^ (poly if c & 1 else 0)
            else:
                c = (c << 1 ^ (poly if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_FRAME_CRC, _TAG_CRC = _table(0x8005, False), _table(0xA001, True)


@lru_cache(4096)
def frame_crc(covered: bytes) -> int:
    """The checksum of a protected frame over whole covered bytes: the header's last two and, in layer III, the side information."""
    c = 0xFFFF
    for b in covered:
        c = c << 8 & 0xFFFF ^ _FRAME_CRC[c >> 8 ^ b]
    return c


def tag_crc(covered: bytes) -> int:
    """The checksum of the encoder's tag within the Xing/Info frame."""
    c = 0
    for b in covered:
        c = c >> 8 ^ _TAG_CRC[c & 0xFF ^ b]
    return c


@lru_cache(65536)
def header(word: int) -> tuple[int, int, int, int, int, bool] | None:
    """(version bits, layer, Hz, samples, bytes, has a checksum) of a frame header, side information aside; None if it is none."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, speed = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate == 3 or speed in (0, 15) or word & 3 == 2:
        return None
    first, hz = version == 3, RATES[version][rate]
    kbit, pad = BITRATES[first, layer][speed], word >> 9 & 1
    if layer == 1:
        return version, layer, hz, 384, (12000 * kbit // hz + pad) * 4, not word >> 16 & 1
    samples = 576 if layer == 3 and not first else 1152
    return version, layer, hz, samples, samples // 8 * kbit * 1000 // hz + pad, not word >> 16 & 1


def _side(version: int, word: int) -> int:
    mono = word >> 6 & 3 == 3
    return (17 if mono else 32) if version == 3 else (9 if mono else 17)


def protected_bits(data: bytes, at: int, version: int, layer: int, word: int) -> int:
    """Bits that a layer I or II frame's checksum covers from `at`, where the frame's bit allocation begins."""
    mode, channels = word >> 6 & 3, 1 if word >> 6 & 3 == 3 else 2
    if layer == 1:
        widths = [4] * 32
    else:
        kbit, hz = BITRATES[version == 3, 2][word >> 12 & 15] // channels, RATES[version][word >> 10 & 3]
        if version != 3:
            name = "half rate"
        elif kbit < 56:
            name = "narrow, 32 kHz" if hz == 32000 else "narrow"
        else:
            name = "wide" if kbit >= 96 and hz != 48000 else "middle"
        widths = [w for w, n in ALLOCATION[name] for _ in range(n)]
    bound = min(len(widths), 4 * (word >> 4 & 3) + 4) if mode == 1 else len(widths)
    bits = channels * sum(widths[:bound]) + sum(widths[bound:])
    if layer == 1:
        return bits
    # Layer II: two bits of scale factor selection for each subband and channel that has bits.
    field = int.from_bytes(data[at : at + (bits + 7) // 8], "big") >> (-bits % 8)
    chosen, left = 0, bits
    for i, w in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            left -= w
            if field >> left & (1 << w) - 1:
                chosen += 1 if i < bound else channels
    return bits + 2 * chosen


def bits_crc(head: bytes, covered: bytes, bits: int) -> int:
    """The checksum of a protected frame over the header's last two bytes and the first `bits` bits of covered."""
    c = frame_crc(head + covered[: bits // 8])
    for k in range(bits % 8):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ covered[bits // 8] >> 7 - k) & 1 else 0)) & 0xFFFF
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


def _tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio may begin, and the text frames of the ID3v2 tags before it."""
    at, out = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, end = data[at + 3], data[at + 5], at + 10 + _unsafe(data[at + 6 : at + 10])
        body = data[at + 10 : end]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\x00", b"\xff")
        k = 0
        if flags & 0x40 and major > 2 and len(body) >= 4:
            k = _unsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
        name, head = (3, 6) if major == 2 else (4, 10)
        while k + head <= len(body) and body[k] != 0:
            size = int.from_bytes(body[k + 3 : k + 6], "big") if major == 2 else _unsafe(body[k + 4 : k + 8]) if major == 4 else int.from_bytes(body[k + 4 : k + 8], "big")
            key, value = body[k : k + name].decode("latin-1"), body[k + head : k + head + size]
            k += head + size
            if key[0] == "T" and value:
                text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace")
                if key in ("TXXX", "TXX"):
                    key, _, text = text.partition("\0")
                out[key] = text.rstrip("\0")
        at = end + (10 if flags & 0x10 else 0)
    return at, out


def carry(payload: bytes) -> bytes:
    """A stream that carries the payload, whole, in the ancillary bytes of its frames."""
    room = _LARGEST[1] - _OVERHEAD
    frames, sizes, k = [], [], 0
    while k < len(payload) or not frames:
        left = len(payload) - k
        speed, size = _LARGEST if left >= room else next(x for x in _SIZES if x[1] - _OVERHEAD >= left)
        head = struct.pack(">I", 0xFFFA08C0 | speed << 12)
        piece = payload[k : k + size - _OVERHEAD]
        frames.append(b"".join((head, struct.pack(">H", frame_crc(head[2:] + bytes(17))), bytes(17), piece, bytes(size - _OVERHEAD - len(piece)))))
        sizes.append(size)
        k += len(piece)
    body = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    tag = b"ID3\x04\0\0" + _syncsafe(len(body)) + body
    return tag + _info(sizes) + b"".join(frames)


def _info(sizes: list[int]) -> bytes:
    """The Xing/Info frame: counts, a seek table of 100 entries and the encoder's tag with its checksum."""
    size = 216
    total, n = size + sum(sizes), len(sizes)
    # All frames but the last have one size, so a frame's place needs no running sum.
    toc = bytes(min(255, 256 * (size + (n * i // 100) * sizes[0]) // total) for i in range(100))
    kind = b"Info" if len(set(sizes)) == 1 else b"Xing"
    head = struct.pack(">I", 0xFFFA08C0 | 3 << 12)
    frame = head + struct.pack(">H", frame_crc(head[2:] + bytes(17))) + bytes(17) + kind + struct.pack(">III", 15, n, total) + toc + struct.pack(">I", 100)
    frame += b"siftspark" + bytes(12) + bytes(3) + bytes(4) + struct.pack(">I", total) + bytes(2)
    frame += struct.pack(">H", tag_crc(frame))
    return frame + bytes(size - len(frame))


def parse(data: bytes | None) -> dict:
    """Tags, table, checks, exact duration and the byte offset of every audio frame."""
    data = data or b""
    at, tags = _tags(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= at + 128:
        end -= 128
        tags.setdefault("id3v1_title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    offsets, speeds, samples, hz = [], set(), 0, 0
    good = bad = skipped = resyncs = 0
    table: dict = {}
    kind, synced, unpack = None, True, struct.Struct(">I").unpack_from
    while at + 4 <= end:
        word = unpack(data, at)[0]
        found = header(word)
        ok = found is not None and at + found[4] <= end and (kind is None or (*found[:3], found[5]) == kind)
        if ok and (not synced or kind is None):  # a first or regained frame must be followed by another, or by the end
            after = at + found[4]
            then = header(unpack(data, after)[0]) if after + 4 <= end else None
            ok = then is not None and (*then[:3], then[5]) == (*found[:3], found[5]) or after == end
        if not ok:
            resyncs += synced
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        version, layer, hz, count, size, checked = found
        synced = True
        first = kind is None
        kind = (*found[:3], found[5])
        body = at + 4 + 2 * checked
        side = _side(version, word) if layer == 3 else 0
        if checked:
            if layer == 3:
                crc = frame_crc(data[at + 2 : at + 4] + data[body : body + side])
            else:
                bits = protected_bits(data, body, version, layer, word)
                covered = data[body : min(body + (bits + 7) // 8, at + size)]
                crc = bits_crc(data[at + 2 : at + 4], covered, bits) if 8 * len(covered) >= bits else -1
            same = crc == int.from_bytes(data[at + 4 : at + 6], "big")
            good += same
            bad += not same
        if first and (table := _vbr(data[at : at + size], body - at + side)):
            table["frame_bytes"] = size
        else:
            offsets.append(at)
            speeds.add(word >> 12 & 15)
            samples += count
        at += size
    skipped += max(0, end - at)
    played = max(0, samples - table.get("delay", 0) - table.get("padding", 0))
    return {
        "tags": tags, "vbr": table, "frames": len(offsets), "offsets": offsets, "sample_rate": hz, "samples": played,
        "layer": kind[1] if kind else 0, "crc_good": good, "crc_bad": bad, "sync_errors": resyncs, "skipped_bytes": skipped,
        "variable": len(speeds) > 1, "duration_us": played * 1_000_000 // hz if hz else 0,
    }


def _vbr(frame: bytes, at: int) -> dict:
    """The Xing/Info or VBRI table of a frame, or nothing."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, k, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(frame[k : k + n]) if name == "toc" else int.from_bytes(frame[k : k + n], "big")
                k += n
        tag = frame[k : k + 36]
        if len(tag) == 36 and tag[:1].strip(b"\0"):
            gap = int.from_bytes(tag[21:24], "big")
            out |= {"encoder": tag[:9].rstrip(b"\0 ").decode("latin-1"), "delay": gap >> 12, "padding": gap & 0xFFF, "tag_ok": tag_crc(frame[: k + 34]) == int.from_bytes(tag[34:], "big") if k + 34 <= 190 else None}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, width, step = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": toc, "frames_per_entry": step}
    return {}


def payload_of(data: bytes, found: dict) -> bytes:
    """The payload that `carry` stored, read back from the frames' ancillary bytes and held against its checksum."""
    size = int(found["tags"]["payload_bytes"])
    ends = [*found["offsets"][1:], len(data)]
    payload = b"".join([data[a + _OVERHEAD : b] for a, b in zip(found["offsets"], ends, strict=True)])[:size]
    if len(payload) != size or f"{zlib.crc32(payload):08x}" != found["tags"]["payload_crc32"]:
        raise ValueError("the stream does not hold its payload")
    return payload


INDEX = "duration_us bigint, samples bigint, sample_rate int, frames int, seek_offsets array<bigint>, vbr_kind string, vbr_frames bigint, crc_good int, crc_bad int, sync_errors int, skipped_bytes bigint, tags map<string,string>"


def audio_index(df: DataFrame, media: str, key: str) -> DataFrame:
    """key and the index of each stream in the binary column `media`; other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [parse(x) for x in part.column(1).to_pylist()]
                cols = [part.column(0), *([x[k] for x in found] for k in ("duration_us", "samples", "sample_rate", "frames", "offsets"))]
                cols += [[x["vbr"].get("kind") for x in found], [x["vbr"].get("frames") for x in found], *([x[k] for x in found] for k in ("crc_good", "crc_bad", "sync_errors", "skipped_bytes"))]
                cols.append([list(x["tags"].items()) for x in found])
                types = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[key, *(c.split()[0] for c in INDEX.split(", "))])

    source = df.select(key, media)
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, {INDEX}")


def feature(found: dict) -> str:
    """What is indexed, as one string: exact length, checks, and a checksum of all seek offsets."""
    seek = zlib.crc32(struct.pack(f"<{len(found['offsets'])}I", *found["offsets"]))
    return f"layer={found['layer']};frames={found['frames']};samples={found['samples']};hz={found['sample_rate']};us={found['duration_us']};vbr={found['vbr'].get('kind')}:{found['vbr'].get('frames')};tag_crc={found['vbr'].get('tag_ok')};crc={found['crc_good']}/{found['crc_good'] + found['crc_bad']};resync={found['sync_errors']};seek={seek:08x}"


def text_digests(df: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): the text carried as a stream, read back from it, with the index of the stored stream.

    After the digests come the exact duration, the sample rate, and the byte offset of every frame, all as parsed.
    A null text is empty; null and repeated ids are kept; extra columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "samples", "sample_rate", "seek_offsets"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = carry(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)))
                found = parse(media)
                back = payload_of(media, found)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), *(found[k] for k in ("duration_us", "samples", "sample_rate", "offsets"))))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_us bigint, samples bigint, sample_rate int, seek_offsets array<bigint>")
