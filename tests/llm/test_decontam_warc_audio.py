import gzip
import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallylog.llm import audio, decontam, warc
from tallylog.llm.common import read

DATA = "/root/testdata/sf0.01"


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 40)).astype(np.uint64)
        assert decontam.common(a, b) == slow_common(a.tolist(), b.tolist())


def test_sketch_is_the_matrix_product():
    texts = [" ".join(np.random.default_rng(k).choice(["aa", "bb", "cc", "dd", "ee"], 70)).encode() for k in range(4)]
    idf = np.ones(decontam.PLACES + 1, np.float32)
    idf[decontam.PLACES] = 0
    probe = np.random.default_rng(9).standard_normal((decontam.PLACES + 1, 6)).astype(np.float32)
    probe[-1] = 0
    total = np.zeros(probe.shape, np.int64)
    decontam.sketch(texts, idf, probe, total)
    total = total / decontam._UNIT
    rows = decontam.padded(*decontam.words_of(texts), decontam.PASSAGE)[0].reshape(-1, decontam.PASSAGE)
    a = np.zeros((len(rows), decontam.PLACES + 1), np.float32)
    np.add.at(a, (np.arange(len(rows))[:, None], rows), 1)
    a[:, -1] = 0
    a /= np.sqrt((rows < decontam.PLACES).sum(1))[:, None]
    assert np.allclose(total[:-1], (a.T @ (a @ probe))[:-1], atol=1e-3)


def test_leaks_found_and_clean_texts_left(spark):
    docs, items = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    held = {r.item_id: r.text for r in items.collect()}
    some = [r.text for r in docs.where("length(text) between 1500 and 2500").orderBy("doc_id").limit(12).collect()]
    planted = []
    for k, text in enumerate(some):
        item = held[k % 8]
        words = text.split()
        paraphrase = [w for j, w in enumerate(item.split()) if j % 7 != 3]
        planted.append((10_000 + k, " ".join(words[:100] + (item.split() if k < 8 else paraphrase) + words[100:]), k % 8))
    more = spark.createDataFrame([(a, b) for a, b, _ in planted] + [(20_000, None), (20_001, ""), (None, held[1]), (10_000, planted[0][1])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs.select("doc_id", "text").union(more), items).collect()}
    assert {(a, c) for a, _, c in planted} <= got and (None, 1) in got
    words = {i: decontam.words_of([t.encode()])[0] for i, t in held.items()}
    texts = {r.doc_id: decontam.words_of([r.text.encode()])[0] for r in docs.collect()}
    exact = {(d, i) for d, t in texts.items() for i, w in words.items() if w.tobytes() in t.tobytes()}
    assert exact <= got
    assert all(decontam.common(words[i], texts[d]) >= 0.6 * len(words[i]) for d, i in got if d in texts)
    odd = spark.createDataFrame([(None, held[1], 1), (5, held[2], 2), (5, "a clean text", 3), (None, None, 4)], "doc_id long, text string, _key int")
    assert sorted(r._key for r in decontam.drop_leaks(odd, items).collect()) == [3, 4]
    clean = decontam.drop_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in got if d in texts})
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


RECORDS = [("response", str(k), f"http://x/{k}", f"<p>{k}</p>".encode() * 40) for k in range(6)]


def archive(compress):
    return [warc.record_bytes(kind, page, url, body, hashlib.sha256(body).hexdigest(), len(body), None, compress) for kind, page, url, body in RECORDS]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    whole = warc.salvage(b"".join(parts))
    assert [r.block.partition(b"\r\n\r\n")[2] for r in whole.records] == [r[3] for r in RECORDS] and not whole.gaps
    for damage in range(3):
        broken = [bytearray(p) for p in parts]
        if damage == 0:
            broken[2][len(broken[2]) // 2] ^= 0xFF
        elif damage == 1:
            broken[2] = broken[2][: len(broken[2]) // 2]
        else:
            broken[2] = bytearray(b"junk WARC/9 \x1f\x8b\x08 junk")
        got = warc.salvage(b"".join(broken))
        assert [r.headers["warc-target-uri"] for r in got.records] == [f"http://x/{k}" for k in (0, 1, 3, 4, 5)]
        at = sum(map(len, broken[:2]))
        assert [(a, b) for a, b, _ in got.gaps] == [(at, at + len(broken[2]))]
    assert warc.salvage(b"") == warc.Salvage() and warc.salvage(b"xx").gaps[0][:2] == (0, 2)


def test_revisits(spark, tmp_path):
    big = "<html>" + "é" * 100
    rows = [(5, "u5", big), (3, "u 3\n", big), (9, None, big), (4, "u4", "small"), (6, "u6", "small"), (7, "u7", None), (8, "u8", "x" * 50_000), (None, "n", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = {r.page_id: r for r in warc.archive_report(df).collect()}
    assert len(got) == len(rows) and {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {5: ("revisit", 3), 9: ("revisit", 3)}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.archive_report(df.limit(0)).count() == 0


def test_broken_files_are_logged(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    parts = archive(True)
    path.write_bytes(parts[0] + b"?" * 10 + parts[1])
    got = warc.read_warc(spark.createDataFrame([(str(path),)], "file string")).collect()
    assert [(r.page_id, r.gap_start, r.gap_end) for r in got] == [(0, None, None), (1, None, None), (None, len(parts[0]), len(parts[0]) + 10)]


def test_resampler_is_the_slow_one():
    signal = np.random.default_rng(0).standard_normal(500).astype(np.float32)
    taps = audio.tables()[0]
    wide = np.concatenate([np.zeros(audio.TAPS // 2), signal, np.zeros(audio.TAPS * 2)])
    want = [float(wide[j * audio.DOWN // audio.UP :][: audio.TAPS] @ taps[j * audio.DOWN % audio.UP]) for j in range(-(-500 * audio.UP // audio.DOWN))]
    assert np.allclose(audio.resample(signal), want, atol=1e-5)
    long = np.random.default_rng(1).standard_normal(60_001).astype(np.float32)
    assert np.allclose(audio.resample(long)[:1000], audio.resample(long[:3000])[:1000], atol=1e-5)
    tone = np.sin(2 * np.pi * 5500 * np.arange(12_000) / audio.RATE).astype(np.float32)
    assert np.abs(audio.resample(tone)[100:-100]).max() < 0.1


def test_frames_and_segments():
    signal = np.zeros(8000, np.float32)
    signal[3000:5000] = np.sin(np.arange(2000))
    frames = audio.log_mel(signal)
    assert frames.shape == (1 + (8000 - audio.FRAME) // audio.HOP, audio.MELS)
    k = 50
    power = np.abs(np.fft.rfft(signal[k * audio.HOP :][: audio.FRAME] * np.hanning(audio.FRAME), audio.FFT)) ** 2
    assert np.allclose(frames[k], np.log10(np.maximum(power @ audio.tables()[2], 1e-10)), atol=1e-3)
    ((start, end),) = audio.segments(frames.mean(1))
    assert abs(start - 3000 / 8000) < 0.03 and abs(end - 5000 / 8000) < 0.03
    table = pa.ipc.open_stream(io.BytesIO(audio.tensors(frames))).read_all()
    assert table.column("frames").type == pa.fixed_shape_tensor(pa.float16(), audio.SHAPE) and table.column("end")[-1].as_py() <= 1.0
    assert audio.from_wav(None) is None and audio.features(b"RIFFxx") is None


def test_media(spark):
    texts = ["", None, "a", "b" * 192, "c" * 193, "é" * 5000, "a"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in audio.media_report(df).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        data = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        frames, made, spans = audio.features(audio.to_wav(data))
        assert r.feature.split(":")[:3] == [str(frames), str(len(spans)), hashlib.sha256(made).hexdigest()]
        assert (r.media_bytes, r.media_sha256) == (len(data) + 44, hashlib.sha256(audio.to_wav(data)).hexdigest())
    assert got[2].feature == got[6].feature != got[3].feature and audio.media_report(df.limit(0)).count() == 0


def test_members_of_several_records_and_old_versions():
    one = archive(False)
    packed = gzip.compress(b"".join(one[:3])) + archive(True)[3]
    assert [r.headers["warc-record-id"] for r in warc.salvage(packed).records] == [f"<urn:page:{k}>" for k in range(4)]
    old = [x.replace(b"WARC/1.1", b"WARC/0.18", 1) for x in one[:3]]
    found = warc.salvage(old[0] + b"damage" + old[1][:40] + old[2])
    assert [r.headers["warc-record-id"] for r in found.records] == ["<urn:page:0>", "<urn:page:2>"] and len(found.gaps) == 1
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"x" * 9_000_000), 0, 1 << 20)
    assert warc.inflate(gzip.compress(b"x" * 9_000_000), 0)[0] == b"x" * 9_000_000
