"""Media columns: telephony audio in WAV containers, decoded with numpy.

Companded samples (mu-law, A-law) are expanded by 256-entry lookup tables built from
their segment rule.  ADPCM is decoded for all blocks of a batch of rows at once: step k of
every block is one numpy operation, as blocks do not depend on each other.  Decoded audio is
resampled by a short polyphase filter and comes out as 16-bit PCM files, to be stored with
the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Stash

#: WAV format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: IMA ADPCM index steps of a code's low three bits.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte: sign, 3-bit segment and 4-bit step, all inverted."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte: even bits inverted, segment 0 linear."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, step + 8, step + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 IMA step sizes (fixed values): each about a tenth above the one before."""
    # fmt: off
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
        22385, 24623, 27086, 29794, 32767,
    ], np.int32)
    # fmt: on


MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), ima_steps()
#: What each (step index, code) adds to the predictor, and the index that follows.
_code = np.arange(16)
_size = (STEPS[:, None] >> 3) + sum((STEPS[:, None] >> (2 - b)) * (_code >> b & 1) for b in range(3))
DELTA = np.where(_code & 8, -_size, _size).astype(np.int32)
AFTER = np.clip(np.arange(89)[:, None] + np.array(INDEX_STEPS)[_code & 7], 0, 88).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM mono blocks, one per row: a 4-byte header, then two codes a byte, low first.

    A header's step index above 88 counts as 88, so that any bytes are a valid block.
    """
    blocks = np.ascontiguousarray(blocks, np.uint8)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    delta, after = DELTA.ravel(), AFTER.ravel()
    for k, pair in enumerate(codes):
        for j, code in enumerate((pair & 15, pair >> 4)):
            at = index * 16 + code
            value = np.clip(value + delta[at], -32768, 32767)
            index = after[at]
            out[1 + 2 * k + j] = value
    return out.T


def resampled(pcm: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """``pcm`` at ``up / down`` times its rate, by a windowed-sinc polyphase filter.

    Eight zero crossings wide at the lower of the two rates; without ``down`` phase 0 keeps
    the samples.  The ends are held.
    """
    if not len(pcm):
        return pcm.astype(np.int16)
    reach = 4 * max(1, -(-down // up))
    taps = np.arange(1 - reach, reach + 1)
    cut = min(1.0, up / down)
    wide = np.pad(pcm.astype(np.float32), (reach - 1, reach), "edge")
    size = -(-len(pcm) * up // down)
    out = np.empty(size, np.int16)
    for phase in range(up):
        # Samples of this phase: every one lies phase / up behind an input sample.
        at = np.arange(phase * pow(down, -1, up) % up if up > 1 else 0, size, up)
        if not len(at):
            continue
        place = at * down // up
        near = taps - phase / up
        weight = np.sinc(near * cut) * (0.5 + 0.5 * np.cos(np.pi * near / (reach + 1)))
        if phase == 0 and down == 1:
            out[at] = pcm[place]
            continue
        whole = np.convolve(wide, (weight / weight.sum())[::-1].astype(np.float32), "valid")
        out[at] = np.clip(np.rint(whole[place]), -32768, 32767)
    return out


def wav(tag: int, rate: int, samples: bytes, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file.  ADPCM has ``block`` bytes a block and tells its samples a block."""
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * block if tag != IMA_ADPCM else rate * block // (1 + 2 * (block - 4))
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, bytes a block and the stored sample bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


#: Blocks of ADPCM that are decoded at once, and their bytes.
BLOCKS_AT_ONCE, BLOCK_BYTES = 1 << 14, 64
#: Format tag, bytes a block and bits a sample of the codecs.
FORMATS = {"mulaw": (MULAW, 1, 8), "alaw": (ALAW, 1, 8), "adpcm": (IMA_ADPCM, BLOCK_BYTES, 4)}


def decoded_batch(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Rate and 16-bit PCM of stored WAV files in any of the four formats, all blocks of a size together."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(files)
    read = [read_wav(media) for media in files]
    by_format: dict[tuple[int, int], list[int]] = {}
    for k, (tag, _, block, _) in enumerate(read):
        by_format.setdefault((tag, block if tag == IMA_ADPCM else 1), []).append(k)
    for (tag, block), rows in by_format.items():
        raw = [np.frombuffer(read[k][3], np.uint8) for k in rows]
        if tag == PCM:
            for k, own in zip(rows, raw, strict=True):
                out[k] = (read[k][1], own.view("<i2"))
            continue
        if tag == IMA_ADPCM:
            raw = [own[: len(own) // block * block] for own in raw]
            every, each = np.concatenate(raw).reshape(-1, block), 1 + 2 * (block - 4)
            pcm = np.concatenate([np.empty(0, np.int16), *(decode_adpcm(every[a : a + BLOCKS_AT_ONCE]).ravel() for a in range(0, len(every), BLOCKS_AT_ONCE))])
            sizes = [len(own) // block * each for own in raw]
        elif tag in (MULAW, ALAW):
            pcm, sizes = (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.concatenate(raw)], [len(own) for own in raw]
        else:
            raise ValueError(f"format {tag}")
        for k, own in zip(rows, np.split(pcm, np.cumsum(sizes)[:-1]), strict=True):
            out[k] = (read[k][1], own)
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * ((-len(raw)) % 64 if raw else 64)


def codec_of(content: bytes) -> str:
    """The codec of a payload: each takes a third of all contents, and equal ones the same."""
    return list(FORMATS)[zlib.crc32(content) % len(FORMATS)]


def features(rate: int, pcm: np.ndarray) -> str:
    """Rate, samples, peak, mean size, sign changes and CRC-32 of PCM."""
    size = np.abs(pcm.astype(np.int32))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"rate={rate};samples={len(pcm)};peak={int(size.max(initial=0))};mean={int(size.sum()) // max(1, len(pcm))};turns={turns};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


#: Rows whose audio one step of a task holds, and bytes of payload at which it holds fewer.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 4 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded size; a row beyond the bound is a part of its own."""
    sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)]
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and (held + size > BYTES_AT_ONCE or k - begin >= ROWS_AT_ONCE):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def stored_audio(docs: DataFrame, *, codec: str | None = None, rate: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, codec, media`` of every row: its text as a telephony file.

    Without ``codec`` the content decides between the three.  A null or empty text is 64 zero
    bytes; a text of any length is one file.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [x.as_py() for x in batch.column(1)]
                contents = [payload(x) for x in texts]
                codecs = [codec or codec_of(x) for x in contents]
                media = [wav(FORMATS[name][0], rate, content, *FORMATS[name][1:]) for name, content in zip(codecs, contents, strict=True)]
                sizes = [len((x or "").encode("utf-8")) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(codecs, pa.string()), pa.array(media, pa.binary())], ["id", "n_bytes", "codec", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(store, f"id {kind}, n_bytes long, codec string, media binary")


def media_columns(docs: DataFrame, *, codec: str | None = None, rate: int = 8000, up: int = 2, down: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Each row's text as telephony audio: stored losslessly, read back, decoded, resampled and measured.

    ``id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, codec, pcm``; ``pcm`` is a WAV file of the resampled 16-bit PCM, ``feature``
    describes it.  With ``keep`` the stored file, ``media``, follows.  The telephony files are
    written to the shared folder first; every value but ``n_bytes`` is taken from what is read
    back, and the audio of many rows is decoded together.  Equal texts give equal values,
    repeated rows repeated results, a null id stays null; other columns are not read.  Two
    narrow passes.
    """
    table = Stash(docs.sparkSession, "media").save(stored_audio(docs, codec=codec, rate=rate, id_col=id_col, text_col=text_col), "audio")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("media")):
                media = batch.column("media").to_pylist()
                back = [read_wav(x)[3] for x in media]
                audio = [(r * up // down, resampled(x, up, down)) for r, x in decoded_batch(media)]
                made = {
                    "id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": pa.array([len(x) for x in back], pa.int64()), "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    "tail_crc32": pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()), "media_bytes": pa.array([len(x) for x in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                    "feature": pa.array([features(*x) for x in audio], pa.string()), "codec": batch.column("codec"), "pcm": pa.array([wav(PCM, r, x.astype("<i2").tobytes(), 2, 16) for r, x in audio], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(made | ({"media": batch.column("media")} if keep else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm binary" + ", media binary" * keep
    return table.mapInArrow(measure, schema).withColumnRenamed("id", id_col)
