"""op2 and op5: exact round trips and brute force."""

import hashlib
import io
import struct
import zlib

import duckdb
import numpy as np
import pytest

from wordloom.llm import media, warc


def test_media_documents(spark, documents):
    rows = {r.doc_id: r for r in media.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(documents)
    for i, text, _ in documents:
        data = text.encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_media_awkward(spark, awkward, write_tables):
    rows = media.query(spark, write_tables(documents=awkward)).collect()
    assert len(rows) == awkward.count() and all(r.feature for r in rows)
    assert len({r.feature for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.payload_bytes for r in rows if r.doc_id in (3, 4)} == {64}
    assert media.tiles(media.store_texts(awkward.limit(0))).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (40, 7), (64, 64)])
def test_formats(shape):
    image = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()


def test_other_netpbm():
    assert media.decode(b"P2\n# note\n2 2\n9\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n2 2\n1 0\n01").tolist() == [[0, 1], [1, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P6 1 1 255\nabc").tolist() == [[[97, 98, 99]]]
    for bad in (b"", b"P5\n2 2\n255\nabc", b"GIF89a", b"P5\n0 2\n255\n"):
        with pytest.raises(media.BadImage):
            media.decode(bad)


def test_area_resize_against_oversampling():
    image = np.random.default_rng(1).integers(0, 256, (10, 6)).astype(np.uint8)
    big = np.repeat(np.repeat(image.astype(float), 4, axis=0), 5, axis=1)  # 40 x 30: both sides divide
    want = big.reshape(4, 10, 5, 6).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 4, 5), want)


def test_bad_media_rows(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "k long, media binary")
    rows = {r.k: r for r in media.tiles(df).collect()}
    assert rows[1].media_bytes is None and rows[1].error is None
    assert rows[2].media_bytes == 4 and rows[2].feature is None and rows[2].error


def plain_means(image, height, width):
    """Means over equal areas, by oversampling each side."""
    h, w = image.shape
    return np.repeat(np.repeat(image.astype(float), height, axis=0), width, axis=1).reshape(height, h, width, w).mean(axis=(1, 3))


def test_media_features(spark, documents):
    """The tile and its difference hash by plain means, for whole texts; the query hashes the tile that it has written."""
    rows = {r.doc_id: r for r in media.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tiles = {r.doc_id: r for r in media.tiles(media.store_texts(docs), keep=["doc_id"]).collect()}
    for i, text, _ in documents:
        data = text.encode()
        image = np.frombuffer(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), np.uint8).reshape(-1, 64)
        tile = np.load(io.BytesIO(tiles[i].tile_npy))
        assert tile.shape == (16, 16) and tile.dtype == np.uint8
        assert np.abs(tile - plain_means(image, 16, 16)).max() <= 0.5 + 1e-6
        small = plain_means(tile, 8, 9)
        darker = small[:, 1:] - small[:, :-1]
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(rows[i].feature), np.uint8)).reshape(8, 8)
        assert ((darker > 0) == bits)[np.abs(darker) > 1e-9].all()
        assert rows[i].tile_sha256 == hashlib.sha256(tiles[i].tile_npy).hexdigest() and rows[i].feature == tiles[i].feature


def test_bmp_bit_fields():
    image = np.arange(16, dtype=np.uint8).reshape(2, 2, 4)
    head = lambda masks: struct.pack("<2sIHHI", b"BM", 66 + 16, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 32, 3, 16, 0, 0, 0, 0) + struct.pack("<3I", *masks)
    assert (media.decode(head(media.MASKS) + image.tobytes()) == image[:, :, 2::-1]).all()
    with pytest.raises(media.BadImage):
        media.decode(head((0xFF, 0xFF00, 0xFF0000)) + image.tobytes())


def test_revisits_are_checked(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 200, "d", "response", None), (2, 200, "d", "revisit", 1), (3, 9, "e", "response", None)]
    assert warc.checked(spark.createDataFrame(good, schema)).count() == 3
    for bad in ((4, 200, "x", "revisit", 1), (4, 100, "d", "revisit", 1), (4, 200, "d", "revisit", 9)):
        with pytest.raises(warc.CorruptRecord):
            warc.checked(spark.createDataFrame([*good, bad], schema))


def pages(spark):
    same, short = "<p>" + "x" * 120, "short"
    rows = [(5, "u", same), (3, None, same), (9, "a\r\nb", same), (3, "u", same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", same), (10, "u", "y" * 3_000_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_warc_awkward(spark, write_tables):
    df = pages(spark)
    rows = warc.query(spark, write_tables(pages=df)).collect()
    same = hashlib.sha256(("<p>" + "x" * 120).encode()).hexdigest()
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_digest == same), key=repr)
    assert got == sorted([(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (3, "response", None), (None, "revisit", 3)], key=repr)
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id in (1, 2, 4, 6, 7, 10)] == [("response", None)] * 6
    assert next((r.record_type, r.refers_to, r.payload_bytes) for r in rows if r.page_id == 8) == ("revisit", 7, 100)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_shuffle_join(spark, write_tables, monkeypatch):
    d = write_tables(pages=pages(spark))
    want = sorted(warc.query(spark, d).collect(), key=repr)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert sorted(warc.query(spark, d).collect(), key=repr) == want


def test_warc_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL})").fetchall()
    assert sorted(tuple(r) for r in warc.query(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_reader_detects_damage():
    digest = hashlib.sha256(b"hello" * 50).hexdigest()
    good = warc.record("response", 1, "u", b"hello" * 50, digest, None)
    assert [p for _, p in warc.read_records(good + good)] == [b"hello" * 50] * 2
    for bad in (warc.record("response", 1, "u", b"hello" * 50, "0" * 64, None), good[:-12]):
        with pytest.raises(warc.CorruptRecord):
            list(warc.read_records(bad))
