import hashlib
import random
import tempfile
import zlib
from pathlib import Path

import strandline.llm.media as media


def test_round_trip():
    rnd = random.Random(1)
    for n in (0, 1, 63, 64, 65, 128, 5000):
        data = rnd.randbytes(n)
        payload = media.pad(data)
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and len(payload) < max(65, n + 64)
        assert media.decode_image(media.encode_image(payload, n)) == (payload, n)


def test_features_of_a_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 40_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "é\x00\x00"), (9004, "x" * 3_000_000), (None, "q"), (9005, "q"), (9005, "q")], "doc_id long, text string")
    rows = media.media_features(docs.select("doc_id", "text").union(extra).withColumn("payload", media.F.lit(1))).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | {r.doc_id: r.text or "" for r in extra.collect()}
    assert len(rows) == docs.count() + 7
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = media.pad(data)
        image = media.encode_image(payload, len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.image_feature(payload))
    assert media.media_features(extra.limit(0)).count() == 0


def test_stored_form_is_a_png_that_other_code_reads():
    """The chunks as the PNG format has them, read without decode_image."""
    import struct

    image = media.encode_image(media.pad(b"abc" * 50), 150)
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    width, height, depth, colour = struct.unpack_from(">IIBB", image, 16)
    assert (width, height, depth, colour) == (64, 3, 8, 0)
    at, packed = 8, b""
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        packed += image[at + 8 : at + 8 + size] if image[at + 4 : at + 8] == b"IDAT" else b""
        at += size + 12
    lines = zlib.decompress(packed)
    assert lines == b"".join(b"\0" + (b"abc" * 50 + bytes(42))[i : i + 64] for i in (0, 64, 128))


def test_feature_by_plain_loops():
    payload = bytes(range(64)) * 7 + bytes(64)
    n = len(payload)
    mean = sum(payload) / n
    deviation = (sum((b - mean) ** 2 for b in payload) / n) ** 0.5
    steps = [abs(payload[i + 1] - payload[i]) for i in range(n - 1) if i % 64 != 63]
    bits = 0
    for band in range(8):
        for block in range(8):
            cell = [payload[band * 64 + block * 8 + k] for k in range(8)]
            bits = bits * 2 + (sum(cell) / 8 > mean)
    assert media.image_feature(payload) == f"{mean:.4f};{deviation:.4f};{sum(steps) / len(steps):.4f};{bits:016x}"


def test_ranges_cover_each_member_once_and_errors_stay_alone(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(50)], "doc_id long, text string").coalesce(1)
    (name, size) = media.write_archives(docs, folder).select("archive", "bytes").first()
    for step in (100, 1000, size * 2):
        assert media.read_archives(spark, folder, range_bytes=step).where("error is null").select("member").distinct().count() == 50
        assert media.read_archives(spark, folder, range_bytes=step).count() == 50
    path = Path(folder, name)
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT") + 20
    data[at] ^= 255
    path.write_bytes(data)
    (Path(folder) / "stray.zip").write_bytes(b"of a failed attempt")
    rows = media.read_archives(spark, folder).collect()
    assert len(rows) == 50 and [r.payload is None for r in rows].count(True) == 1 and [bool(r.error) for r in rows].count(True) == 1
