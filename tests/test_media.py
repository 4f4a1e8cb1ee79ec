"""Media containers made byte by byte, and what is read of them."""

import io
import struct
import wave

import pytest

from lodestar.sources import extract, media


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4_file(seconds, width=0, height=0, frames=0, sound=b"", long=False):
    clock = struct.pack(">B3xQQIQ", 1, 0, 0, 600, int(seconds * 600)) if long else struct.pack(">B3xIIII", 0, 0, 0, 600, int(seconds * 600))
    tracks = []
    if width:
        stbl = box(b"stbl", box(b"stts", struct.pack(">IIIIII", 0, 2, frames - 10, 20, 10, 20)))
        tracks.append(box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", width << 16, height << 16)), box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8) + b"vide" + bytes(12)), box(b"minf", stbl))))
    if sound:
        tracks.append(box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8) + b"soun" + bytes(12)))))
    return box(b"ftyp", b"isom" + bytes(4)) + box(b"free") + box(b"moov", box(b"mvhd", clock, bytes(80)), *tracks) + box(b"mdat", sound)


def element(name, body, size=None):
    head = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return head + (b"\x01\xff\xff\xff\xff\xff\xff\xff" if size == "unknown" else (len(body) | 1 << 56).to_bytes(8, "big")) + body


def mkv_file(seconds, width, height, fps, size=None, double=True):
    info = element(media.INFO, element(media.SCALE, (1_000_000).to_bytes(3, "big")) + element(media.DURATION, struct.pack(">d" if double else ">f", seconds * 1000)))
    sound = element(media.TRACK, element(media.KIND, b"\x02"))
    video = element(media.TRACK, element(media.KIND, b"\x01") + element(media.FRAME_TIME, int(1e9 / fps).to_bytes(4, "big")) + element(media.VIDEO, element(media.WIDTH, width.to_bytes(2, "big")) + element(media.HEIGHT, height.to_bytes(2, "big"))))
    return element(0x1A45DFA3, b"\x42\x86\x81\x01") + element(media.SEGMENT, info + element(media.TRACKS, sound + video) + element(media.CLUSTER, bytes(50), size), size)


def mp3_frames(n, rate=9, xing=None):
    """MPEG-1 layer 3, 128 kbit/s, 44.1 kHz, stereo: 417 bytes a frame."""
    frame = b"\xff\xfb" + bytes([rate << 4]) + b"\x00" + bytes(413)
    if xing:
        frame = frame[:36] + b"Xing" + struct.pack(">II", 1, xing) + frame[48:]
    return frame + (b"\xff\xfb" + bytes([rate << 4]) + b"\x00" + bytes(413)) * (n - 1)


def page(serial, position, body):
    cuts = [255] * (len(body) // 255) + [len(body) % 255]
    return b"OggS\x00\x00" + struct.pack("<qIII", position, serial, 0, 0) + bytes([len(cuts), *cuts]) + body


CASES = [
    ("clip.mp4", "video", mp4_file(12.4, 640, 360, 372), {"duration": 12, "width": 640, "height": 360, "fps": 30.0}),
    ("long.mov", "video", mp4_file(7200, 1920, 1080, 172_800, long=True), {"duration": 7200, "width": 1920, "height": 1080, "fps": 24.0}),
    ("song.m4a", "audio", mp4_file(10, sound=bytes(160_000)), {"duration": 10, "bitrate": 128}),
    ("clip.mkv", "video", mkv_file(61.5, 320, 240, 25), {"duration": 62, "width": 320, "height": 240, "fps": 25.0}),
    ("live.webm", "video", mkv_file(5, 1280, 720, 29.97, "unknown", False), {"duration": 5, "width": 1280, "height": 720, "fps": 30.0}),
    ("old.avi", "video", b"RIFF" + bytes(4) + b"AVI LIST" + bytes(4) + b"hdrlavih" + struct.pack("<14I", 56, 40_000, 0, 0, 0, 250, 0, 2, 0, 176, 144, 0, 0, 0), {"duration": 10, "width": 176, "height": 144, "fps": 25.0}),
    ("plain.mp3", "audio", b"ID3\x04\x00\x00\x00\x00\x01\x00" + bytes(128) + mp3_frames(400), {"duration": 10, "bitrate": 128}),
    ("variable.mp3", "audio", mp3_frames(400, xing=800), {"duration": 21, "bitrate": 64}),
    ("noise.mp3", "audio", b"\xff\x00\xff\xfb\x00" + mp3_frames(100), {"duration": 3, "bitrate": 128}),
    ("song.ogg", "audio", page(7, 0, b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44100, 0, 112_000, 0)) + page(9, 999_999_999, b"x") + page(7, 441_000, bytes(700)), {"duration": 10, "bitrate": 112}),
    ("talk.opus", "audio", page(1, 0, b"OpusHead\x01\x02" + struct.pack("<H", 312)) + page(1, 48_000 * 4 + 312, bytes(3000)), {"duration": 4, "bitrate": 6}),
    ("pure.flac", "audio", b"fLaC\x00\x00\x00\x22" + bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 441_000).to_bytes(8, "big") + bytes(100_000), {"duration": 10, "bitrate": 80}),
]


@pytest.mark.parametrize("name, category, content, want", CASES, ids=[c[0] for c in CASES])
def test_heads_of_containers(name, category, content, want):
    got = media.probe(content, category)
    assert {k: v for k, v in got.items() if k != "bitrate"} == {k: v for k, v in want.items() if k != "bitrate"}
    assert abs(got.get("bitrate", 0) - want.get("bitrate", 0)) <= 1


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_broken_files_have_no_metadata_and_end(case):
    _, category, content, _ = case
    for cut in range(0, min(len(content), 400), 3):
        assert isinstance(media.probe(content[:cut], category), dict)
    assert media.probe(b"", category) == media.probe(b"text", category) == media.probe(b"\xff" * 3000, category) == {}


def test_metadata_over_files(spark):
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(bytes(4 * 8000 * 3))
    rows = [(n, "." + n.split(".")[1], c, bytearray(b)) for n, c, b, _ in CASES] + [("a.wav", ".wav", "audio", bytearray(sound.getvalue())), ("bad.mp4", ".mp4", "video", bytearray(b"junk")), ("none.mkv", ".mkv", "video", None)]
    got = {r.path: {k: v for k, v in r.metadata.asDict().items() if v is not None} for r in extract.metadata(spark.createDataFrame(rows, "path string, extension string, category string, content binary")).collect()}
    for name, _, _, want in CASES:
        assert got[name].keys() == want.keys() and got[name]["duration"] == want["duration"]
    assert got["a.wav"] == {"duration": 3, "bitrate": 256} and got["bad.mp4"] == got["none.mkv"] == {}
