"""SRC-25: duration, bitrate, picture size and frame rate from the heads of media containers: MP4, Matroska, AVI, MP3, Ogg, FLAC.

Each reader takes a file's bytes and gives what it finds of duration (seconds), bitrate (bits a second), width, height and fps.
Sizes that run past the end of the file are cut there; what doesn't parse raises, and ``probe`` gives nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

# MPEG audio bitrates in kbit/s by (MPEG-1 or not, layer), sample rates by version, samples of a frame.
MPEG1_BITRATES = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
MPEG2_BITRATES = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Matroska's element ids.
SEGMENT, INFO, SCALE, DURATION, TRACKS, TRACK, KIND, FRAME_TIME, VIDEO, WIDTH, HEIGHT, CLUSTER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x83, 0x23E383, 0xE0, 0xB0, 0xBA, 0x1F43B675


def boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(type, content) of the boxes of an MP4 file or box."""
    at = 0
    while at + 8 <= len(data):
        size, head = struct.unpack_from(">I", data, at)[0], 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            return
        yield bytes(data[at + 4 : at + 8]), data[at + head : at + size]
        at += size


def _inside(data: memoryview, *path: bytes) -> memoryview | None:
    for name in path:
        data = next((x for kind, x in boxes(data) if kind == name), None)
        if data is None:
            return None
    return data


def _clock(box: memoryview) -> float:
    """Seconds that a movie or media header gives."""
    scale, length = struct.unpack_from(">IQ", box, 20) if box[0] == 1 else struct.unpack_from(">II", box, 12)
    return length / scale if scale else 0.0


def mp4(content: bytes) -> dict:
    whole = memoryview(content)
    movie = _inside(whole, b"moov")
    found = {"duration": _clock(_inside(movie, b"mvhd"))}
    sound = False
    for kind, track in boxes(movie):
        handler = _inside(track, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None:
            continue
        if bytes(handler[8:12]) == b"vide" and "width" not in found:
            width, height = struct.unpack(">II", _inside(track, b"tkhd")[-8:])
            found |= {"width": width >> 16, "height": height >> 16}
            times, seconds = _inside(track, b"mdia", b"minf", b"stbl", b"stts"), _clock(_inside(track, b"mdia", b"mdhd"))
            if times is not None and seconds:
                samples = sum(struct.unpack_from(">I", times, 8 + 8 * i)[0] for i in range(struct.unpack_from(">I", times, 4)[0]))
                found["fps"] = samples / seconds
        sound |= bytes(handler[8:12]) == b"soun"
    if sound and "width" not in found and found["duration"]:
        found["bitrate"] = 8 * sum(len(x) for kind, x in boxes(whole) if kind == b"mdat") / found["duration"]
    return found


def elements(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(id, content) of Matroska elements; one of unknown size goes to the end."""
    at = 0
    while at < len(data):
        length = 9 - data[at].bit_length()
        name = int.from_bytes(data[at : at + length], "big")
        at += length
        if length > 4 or at >= len(data):
            return
        length = 9 - data[at].bit_length()
        size = int.from_bytes(data[at : at + length], "big") - (1 << 7 * length)
        unknown = size == (1 << 7 * length) - 1
        at += length
        yield name, data[at : len(data) if unknown else at + size]
        at = len(data) if unknown else at + size


def matroska(content: bytes) -> dict:
    found: dict = {}
    number = lambda x: int.from_bytes(x, "big")
    for name, part in ((n, x) for top, segment in elements(memoryview(content)) if top == SEGMENT for n, x in elements(segment)):
        if name == INFO:
            info = dict(elements(part))
            if DURATION in info:
                ticks = struct.unpack(">f" if len(info[DURATION]) == 4 else ">d", info[DURATION])[0]
                found["duration"] = ticks * number(info.get(SCALE, (1_000_000).to_bytes(4, "big"))) / 1e9
        elif name == TRACKS:
            for kind, track in elements(part):
                own = dict(elements(track)) if kind == TRACK else {}
                if own and number(own[KIND]) == 1 and "width" not in found:
                    size = dict(elements(own[VIDEO]))
                    found |= {"width": number(size[WIDTH]), "height": number(size[HEIGHT])}
                    if FRAME_TIME in own:
                        found["fps"] = 1e9 / number(own[FRAME_TIME])
        elif name == CLUSTER:  # heads come before the pictures
            break
    return found


def avi(content: bytes) -> dict:
    at = content.index(b"avih")
    per_frame, frames, width, height = (struct.unpack_from("<I", content, at + 8 + i)[0] for i in (0, 16, 32, 36))
    return {"duration": per_frame * frames / 1e6, "width": width, "height": height} | ({"fps": 1e6 / per_frame} if per_frame else {})


def _frame(content: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(bytes, samples, sample rate, where a frame count may be) of the MPEG audio frame at a place."""
    if at + 4 > len(content) or content[at] != 0xFF or content[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = content[at + 1] >> 3 & 3, 4 - (content[at + 1] >> 1 & 3)
    rate, hertz, padding = content[at + 2] >> 4, content[at + 2] >> 2 & 3, content[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or not 0 < rate < 15 or hertz == 3:
        return None
    kilobits, hertz = (MPEG1_BITRATES if version == 3 else MPEG2_BITRATES)[layer][rate - 1], SAMPLE_RATES[version][hertz]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * kilobits * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kilobits * 1000 // hertz + padding
    mono = content[at + 3] >> 6 == 3
    return size, samples, hertz, at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))


def mp3(content: bytes) -> dict:
    """By the frame count of a variable bitrate's first frame, else by all frames."""
    at = 0
    if content[:3] == b"ID3":
        at = 10 + sum((content[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    while not ((first := _frame(content, at)) and _frame(content, at + first[0])):  # two in a row are no chance
        at += 1
        if at > len(content) - 4:
            raise ValueError("no frame")
    _, samples, hertz, head = first
    if content[head : head + 4] in (b"Xing", b"Info") and content[head + 7] & 1:
        seconds = struct.unpack_from(">I", content, head + 8)[0] * samples / hertz
        return {"duration": seconds, "bitrate": 8 * (len(content) - at) / seconds}
    size = frames = 0
    while frame := _frame(content, at):
        size, frames, at = size + frame[0], frames + 1, at + frame[0]
    seconds = frames * samples / hertz
    return {"duration": seconds, "bitrate": 8 * size / seconds}


def ogg(content: bytes) -> dict:
    """By the last position of the first stream."""
    at, serial, rate, skip, nominal, last = 0, None, 0, 0, 0, 0
    while (at := content.find(b"OggS", at)) >= 0 and at + 27 <= len(content):
        position, own = struct.unpack_from("<qI", content, at + 6)
        body = at + 27 + content[at + 26]
        if serial is None:
            serial = own
            if content[body : body + 7] == b"\x01vorbis":
                rate, nominal = struct.unpack_from("<I", content, body + 12)[0], struct.unpack_from("<i", content, body + 20)[0]
            elif content[body : body + 8] == b"OpusHead":
                rate, skip = 48000, struct.unpack_from("<H", content, body + 10)[0]
            else:
                raise ValueError("neither Vorbis nor Opus")
        if own == serial and position > 0:
            last = position
        at = body + sum(content[at + 27 : body])
    seconds = (last - skip) / rate
    return {"duration": seconds, "bitrate": nominal if nominal > 0 else 8 * len(content) / seconds}


def flac(content: bytes) -> dict:
    packed = int.from_bytes(content[18:26], "big")
    seconds = (packed & (1 << 36) - 1) / (packed >> 44)
    return {"duration": seconds} | ({"bitrate": 8 * len(content) / seconds} if seconds else {})


def reader(content: bytes) -> Callable[[bytes], dict] | None:
    """The container's reader, by its first bytes."""
    head = content[:12]
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide"):
        return mp4
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return avi
    known = {b"\x1aE\xdf\xa3": matroska, b"OggS": ogg, b"fLaC": flac}
    return known.get(head[:4]) or (mp3 if head[:3] == b"ID3" or head[:1] == b"\xff" else None)


def probe(content: bytes, category: str) -> dict:
    """Whole seconds, whole kbit/s (sound only), size and fps (pictures only, one decimal); nothing if the file can't be read."""
    try:
        read = reader(content)
        found = read(content) if read else {}
    except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, struct.error):
        return {}
    if not found:
        return {}
    out = {"duration": round(found.get("duration", 0))}
    if category == "audio":
        return out | ({"bitrate": round(found["bitrate"] / 1000)} if found.get("bitrate") else {})
    return out | {n: found[n] for n in ("width", "height") if n in found} | ({"fps": round(found["fps"], 1)} if "fps" in found else {})
