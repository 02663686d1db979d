import hashlib
import zlib

import numpy as np
import pytest

from folioworks.llm import media


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3])
def test_filters_round_trip(kind, channels):
    data = np.random.default_rng(kind).integers(0, 256, 192 * 7, np.uint8).tobytes()
    rows, found = media.decode_png(media.encode_png(data, channels=channels, kind=kind))
    assert (rows.tobytes(), found) == (data, channels)


def test_mixed_filters_round_trip():
    rows = np.random.default_rng(1).integers(0, 256, (40, 192), np.uint8)
    body = np.empty((40, 193), np.uint8)
    for i in range(40):
        body[:, 0][i] = kind = (i // 3) % 5
        body[i, 1:] = media._filtered(rows[: i + 1], kind, 3)[-1]
    assert (media._unfiltered(body, 3) == rows).all()


def test_damage_is_found():
    file = bytearray(media.encode_png(media.padded(b"some text")))
    for at in (9, 20, 45, len(file) - 2):
        broken = file.copy()
        broken[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(bytes(file[:-12]))


def test_columns(spark):
    texts = [None, "", "a" * 192, "a" * 193, "é\n" * 5000, "é\n" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_bytes", __import__("pyspark").sql.functions.lit("clash"))
    found = {r.doc_id: r for r in media.read_media(media.with_media(docs), payload=True).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + b" " * (-len(data) % 192 if data else 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len(data), len(whole), whole)
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-16:])
        assert len(r.feature) == 16
    assert found[4].feature == found[5].feature and found[4].media_sha256 == found[5].media_sha256
    assert media.read_media(media.with_media(docs.limit(0))).count() == 0
