"""AVI motion-JPEG columns: RIFF indexes, intra frames, and shots by adaptive histogram differences.

``clips`` turns a column of files into timed clip rows.  ``store`` and ``payload`` keep bytes losslessly in such a file:
each byte is a quantised coefficient (the format's unit) of an 8 x 8 block, a frame has BLOCKS_ACROSS x BLOCKS_DOWN
blocks, and a comment gives the payload's length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import common, jpeg

BLOCKS_ACROSS, BLOCKS_DOWN = 8, 2
FRAME_BLOCKS = BLOCKS_ACROSS * BLOCKS_DOWN
WIDTH, HEIGHT = 8 * BLOCKS_ACROSS, 8 * BLOCKS_DOWN
FRAME_MICROSECONDS = 40_000
#: The byte that coefficient 0 stands for: letters are near it, so they take few bits.
ZERO_BYTE = 108
#: Frames that are encoded or decoded side by side.
GROUP_FRAMES = 1024
BINS = 32
#: A shot begins where a histogram difference is over MEAN_PLUS standard deviations above the mean of the shot's up to
#: PAST differences before, and over LEAST (both kinds of difference are shares of all pixels).
PAST, MEAN_PLUS, LEAST = 12, 3.0, 0.12


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, microseconds: int = FRAME_MICROSECONDS, comment: bytes = b"") -> bytes:
    """A file with one video stream and its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<10I16x", microseconds, 0, 0, 0x10, len(frames), 0, 1, largest, width, height)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, microseconds, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    heads = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b""
    index, body, at = [], [b"movi"], 4
    for frame in frames:
        n = len(frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, n))
        body.append(b"00dc" + struct.pack("<I", n) + frame + b"\0" * (n & 1))
        at += 8 + n + (n & 1)
    return _chunk(b"RIFF", b"AVI " + heads + info + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[int, list[bytes], bytes]:
    """Microseconds per frame, the video frames and the comment; raises ValueError for other files.

    Frames come from the index (offsets from the movie list or from the file's begin); without one, and in the further
    RIFF parts of a large file, the lists are walked.  Only the first video stream counts.  An empty chunk is a dropped
    frame: the one before it stays (at the begin the first that comes), so every chunk is a frame's time.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found = {"rate": 0, "movies": [], "comment": b"", "index": b"", "kinds": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body, stop = at + 8, min(at + 8 + n, len(data))
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    found["movies"].append((body, stop))
                else:
                    walk(body + 4, stop)
            elif name == b"avih":
                found["rate"] = int.from_bytes(data[body : body + 4], "little")
            elif name == b"strh":
                found["kinds"].append(data[body : body + 4])
            elif name == b"ICMT":
                found["comment"] = data[body:stop].rstrip(b"\0")
            elif name == b"idx1" and not found["index"]:
                found["index"] = data[body:stop]
            at = body + n + (n & 1)

    at = 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        walk(at + 12, min(at + 8 + n, len(data)))
        at += 8 + n + (n & 1)
    chunks, movies = [], found["movies"]
    entries = list(struct.iter_unpack("<4sIII", found["index"][: len(found["index"]) // 16 * 16]))
    if entries and movies:
        movie = movies[0][0]
        base = movie if data[movie + entries[0][2] : movie + entries[0][2] + 4] == entries[0][0] else 0
        chunks, movies = [(name, base + at + 8, n) for name, _, at, n in entries], movies[1:]
    for movie, end in movies:
        at = movie + 4
        while at + 8 <= end:
            name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":  # a group of chunks
                at += 12
                continue
            chunks.append((name, at + 8, n))
            at += 8 + n + (n & 1)
    chunks = [c for c in chunks if c[0][2:] in (b"dc", b"db")]
    stream = b"%02d" % found["kinds"].index(b"vids") if b"vids" in found["kinds"] else chunks[0][0][:2] if chunks else b""
    own = [data[at : at + n] for name, at, n in chunks if name[:2] == stream]
    frames, held = [], next((f for f in own if f), None)
    for frame in own if held is not None else []:
        held = frame or held
        frames.append(held)
    return found["rate"], frames, found["comment"]


def pad(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def _levels(payload: bytes) -> np.ndarray:
    """Coefficients of whole frames; after the payload they are 0."""
    values = (np.frombuffer(payload, np.uint8) - np.uint8(ZERO_BYTE)).view(np.int8)
    out = np.zeros(-(-len(values) // (64 * FRAME_BLOCKS)) * 64 * FRAME_BLOCKS, np.int8)
    out[: len(values)] = values
    return out.reshape(-1, 64)


def store(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload."""
    levels = [_levels(p) for p in payloads]
    counts = [len(x) // FRAME_BLOCKS for x in levels]
    blocks, frames = np.concatenate(levels), []
    for at in range(0, len(blocks), GROUP_FRAMES * FRAME_BLOCKS):
        frames += jpeg.encode_frames(blocks[at : at + GROUP_FRAMES * FRAME_BLOCKS], FRAME_BLOCKS, WIDTH, HEIGHT)
    out, at = [], 0
    for payload, n in zip(payloads, counts):
        out.append(write_avi(frames[at : at + n], WIDTH, HEIGHT, comment=b"%d" % len(payload)))
        at += n
    return out


def histograms(decoded: list[tuple[jpeg.Layout, np.ndarray]]) -> np.ndarray:
    """Luma histograms of frames, BINS each."""
    out = np.zeros((len(decoded), BINS), np.int64)
    at = 0
    while at < len(decoded):  # runs of one layout
        end, layout = at, decoded[at][0]
        while end < len(decoded) and decoded[end][0] is layout:
            end += 1
        found = jpeg.pixels(layout, np.concatenate([blocks for _, blocks in decoded[at:end]]))
        per = len(found) // (end - at) * 64
        which = np.repeat(np.arange(end - at) * BINS, per)
        out[at:end] = np.bincount(which + found.reshape(-1) // (256 // BINS), minlength=(end - at) * BINS).reshape(-1, BINS)
        at = end
    return out


def shots(hists: np.ndarray) -> list[int]:
    """First frames of shots."""
    if not len(hists):
        return []
    shares = hists / np.maximum(hists.sum(1, keepdims=True), 1)
    changes = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    begins, past = [0], []
    for t, change in enumerate(changes.tolist(), 1):
        recent = past[-PAST:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if len(recent) >= 2 and change > LEAST and change > mean + MEAN_PLUS * spread:
            begins.append(t)
            past = []
        else:
            past.append(change)
    return begins


def _decode_files(files: list[bytes], decoder: jpeg.Decoder) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Of each file: microseconds per frame, comment, coefficients (blocks, 64) and histograms."""
    parsed = [read_avi(f) for f in files]
    frames = [frame for _, own, _ in parsed for frame in own]
    levels, hists = [], []
    for at in range(0, len(frames), GROUP_FRAMES):
        decoded = decoder.luma(frames[at : at + GROUP_FRAMES])
        levels += [blocks.astype(np.int8) if np.abs(blocks).max(initial=0) <= 128 else blocks for _, blocks in decoded]
        hists.append(histograms(decoded))
    hist, at = np.concatenate(hists) if hists else np.zeros((0, BINS), np.int64), 0
    for rate, own, comment in parsed:
        part = levels[at : at + len(own)]
        yield rate, comment, np.concatenate(part) if part else np.zeros((0, 64), np.int8), hist[at : at + len(own)]
        at += len(own)


def payload(levels: np.ndarray, comment: bytes) -> bytes:
    """Stored bytes, from coefficients as decoded."""
    return (levels.reshape(-1).astype(np.int16) + ZERO_BYTE).astype(np.uint8).tobytes()[: int(comment)]


CLIP = T.StructType([T.StructField(n, k) for n, k in (("clip", T.IntegerType()), ("first_frame", T.IntegerType()), ("frames", T.IntegerType()), ("begin_s", T.DoubleType()), ("end_s", T.DoubleType()), ("mean_luma", T.DoubleType()), ("status", T.StringType()))])


def _clip_rows(rate: int, hists: np.ndarray) -> list[tuple]:
    begins = [*shots(hists), len(hists)]
    middles = (np.arange(BINS) + 0.5) * (256 / BINS)
    out = []
    for i, (a, b) in enumerate(zip(begins, begins[1:])):
        h = hists[a:b].sum(0)
        out.append((i, a, b - a, a * rate / 1e6, b * rate / 1e6, round(float((h * middles).sum() / max(h.sum(), 1)), 3)))
    return out


def clips(files: DataFrame, media: str = "media") -> DataFrame:
    """A row for each shot of each file: the other columns, and clip, first_frame, frames, begin_s, end_s, mean_luma and
    status, which is ``shot``.

    A file without shots has one row with nulls: its status is ``empty`` for null files and files without frames, and
    ``unreadable`` for what isn't AVI motion-JPEG.  Names that are taken get an underscore.
    """
    rest = [f for f in files.schema.fields if f.name != media]
    names = common.fresh(files.drop(media), *CLIP.fieldNames())
    schema = T.StructType([*rest, *[T.StructField(n, f.dataType) for n, f in zip(names, CLIP.fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = jpeg.Decoder()
        for batch in batches:
            place, rows = [], []
            for i, value in enumerate(common.column(batch, media)):
                data, status, found = value.as_py(), "empty", []
                if data:
                    try:
                        rate, _, _, hists = next(_decode_files([data], decoder))
                        found = [(*clip, "shot") for clip in _clip_rows(rate, hists)]
                    except (ValueError, IndexError, struct.error, KeyError):
                        status = "unreadable"
                found = found or [(*[None] * (len(names) - 1), status)]
                place += [i] * len(found)
                rows += found
            kept = batch.select([f.name for f in rest]).take(pa.array(place, pa.int64()))
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int32()] * 3 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*[f.name for f in rest], *names])

    return files.mapInArrow(run, schema)


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds a file that holds the text (null: empty) as UTF-8, padded with zeros to a positive multiple of 64."""
    (media,) = common.fresh(docs, media)
    schema = T.StructType([*docs.schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(store([pad(t.encode()) for t in texts]), pa.binary())], names=[*part.schema.names, media])

    return docs.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its text stored and read back, and its shots: frames, then each shot's first frame and mean luma.

    Null and empty texts hold 64 zeros.  Equal texts have equal files and features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = jpeg.Decoder()
        for part, texts in common.steps(batches, "text"):
            rows = []
            raw = [t.encode() for t in texts]
            files = store([pad(r) for r in raw])
            for own, data, (rate, comment, levels, hists) in zip(raw, files, _decode_files(files, decoder)):
                back = payload(levels, comment)
                feature = f"frames={len(hists)};clips=" + ",".join(f"{c[1]}+{c[2]}@{c[5]}" for c in _clip_rows(rate, hists))
                rows.append((len(own), len(back), sha256(back).hexdigest(), crc32(back[-64:]), len(data), sha256(data).hexdigest(), feature))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[f.split()[0] for f in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
