import hashlib
import zlib

import numpy as np
import pyarrow as pa

from loamline.llm import media

from .fixtures import awkward_rows, frame


def test_tables_have_the_codecs_known_values():
    assert media.MULAW_PCM[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + media.INDEX_STEPS[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_equal_a_scalar_decoder():
    blocks = np.random.default_rng(3).integers(0, 256, (50, 64), np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]


def test_resampling_keeps_samples_and_interpolates():
    wave = (8000 * np.sin(np.arange(400) * 0.2)).astype(np.int16)
    twice = media.resampled(wave)
    assert (twice[::2] == wave).all()
    assert np.abs(twice[41:-41:2] - 8000 * np.sin((np.arange(400) + 0.5) * 0.2)[20:-20][: len(twice[41:-41:2])]).max() < 80


def test_resampling_by_a_ratio_follows_the_wave():
    wave = lambda rate: 8000 * np.sin(2 * np.pi * 300 * np.arange(800 * rate // 8000) / rate)
    for up, down in ((1, 2), (3, 2), (2, 3), (5, 1)):
        got = media.resampled(wave(8000).astype(np.int16), up, down)
        want = wave(8000 * up // down)
        assert len(got) == -(-800 * up // down)
        assert np.abs(got[30:-30] - want[30 : len(got) - 30]).max() < 160, (up, down)
    assert len(media.resampled(np.empty(0, np.int16), 1, 2)) == 0


def plain_pcm(name, content):
    if name == "adpcm":
        return [x for k in range(0, len(content), 64) for x in plain_adpcm(content[k : k + 64])]
    return [int((media.MULAW_PCM if name == "mulaw" else media.ALAW_PCM)[b]) for b in content]


def test_media_round_trip(spark):
    rows = awkward_rows()
    want = {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        want[i] = (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    contents = {i: media.payload(text) for i, text, *_ in rows}
    for codec in (*media.FORMATS, None):
        got = media.media_columns(frame(spark, rows), codec=codec, keep=True).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
            assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
            assert r.codec == (codec or media.codec_of(contents[r.doc_id]))
            assert media.read_wav(bytes(r.media))[:1] == media.FORMATS[r.codec][:1]
            # PCM and feature by the scalar decoder, row by row.
            pcm = media.resampled(np.array(plain_pcm(r.codec, contents[r.doc_id]), np.int16))
            rate, stored = media.decoded_batch([bytes(r.pcm)])[0]
            assert rate == 16000 and (stored == pcm).all() and stored[::2].tolist() == plain_pcm(r.codec, contents[r.doc_id])
            size = [abs(int(x)) for x in pcm]
            turns = sum((a < 0) != (b < 0) for a, b in zip(pcm[1:].tolist(), pcm[:-1].tolist(), strict=True))
            assert r.feature == f"rate=16000;samples={len(pcm)};peak={max(size)};mean={sum(size) // len(size)};turns={turns};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"
        assert codec or {r.codec for r in got} == set(media.FORMATS)
    assert media.media_columns(frame(spark, [])).collect() == []


def test_batches_are_cut_into_steps_of_bounded_size(monkeypatch):
    monkeypatch.setattr(media, "BYTES_AT_ONCE", 100)
    monkeypatch.setattr(media, "ROWS_AT_ONCE", 3)
    texts = ["x" * n for n in (10, 95, 300, 1, 1, 1, 1)] + [None, "", "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(media.slices(batch, 1))
    assert [p.num_rows for p in parts] == [1, 1, 1, 3, 3, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_a_batch_of_blocks_is_decoded_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(5)
    files = [media.wav(*[media.FORMATS[c][0], 8000, rng.integers(0, 256, 64 * n, np.uint8).tobytes(), *media.FORMATS[c][1:]]) for c, n in (("adpcm", 5), ("mulaw", 2), ("adpcm", 9), ("alaw", 1), ("adpcm", 1))]
    whole = [x[1].tolist() for x in media.decoded_batch(files)]
    monkeypatch.setattr(media, "BLOCKS_AT_ONCE", 4)
    assert [x[1].tolist() for x in media.decoded_batch(files)] == whole
    assert whole == [plain_pcm(c, media.read_wav(f)[3]) for c, f in zip(("adpcm", "mulaw", "adpcm", "alaw", "adpcm"), files, strict=True)]
