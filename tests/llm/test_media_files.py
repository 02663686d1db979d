"""Files with real row filters, broken files, and the feature against a plain transform."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import media, queries


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice("river stone house bread morning light garden paper window".split()) for _ in range(n)).encode()


def plain_undo(body, channels):
    """Byte by byte, as the format defines the filters."""
    out = []
    for line in body.tolist():
        kind, row, up = line[0], [], out[-1] if out else [0] * (len(line) - 1)
        for i, v in enumerate(line[1:]):
            a, b, c = (row[i - channels] if i >= channels else 0), up[i], (up[i - channels] if i >= channels else 0)
            if kind == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[kind]
            row.append((v + guess) % 256)
        out.append(row)
    return out


@pytest.mark.parametrize("channels", [1, 3])
def test_many_pictures_are_undone_like_one(channels):
    rng = np.random.default_rng(channels)
    bodies = [np.c_[rng.integers(0, 5, h), rng.integers(0, 256, (h, 24))].astype(np.uint8) for h in (1, 7, 2, 40, 1, 13)]
    for body, rows in zip(bodies, media.unfiltered(bodies, channels)):
        assert rows.tolist() == plain_undo(body, channels)
    assert media.unfiltered([], channels) == []


def test_each_row_has_its_best_filter():
    rows = np.frombuffer(media.padded(prose(900)), np.uint8).reshape(-1, 192)
    body = media.filtered(rows, 3)
    costs = [np.abs(media._filtered(rows, k, 3).view(np.int8).astype(int)).sum(axis=1) for k in range(5)]
    assert body[:, 0].tolist() == np.argmin(costs, axis=0).tolist() and len(set(body[:, 0].tolist())) > 1
    assert plain_undo(body, 3) == rows.tolist()


def test_reading_undoes_real_filters(spark, tmp_path, monkeypatch):
    rows = [(i, prose(50 + 40 * i, i).decode()) for i in range(8)] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def digests():
        return {r.doc_id: r.payload_sha256 for r in queries.QUERIES["op7_media"](spark, str(tmp_path)).collect()}

    right = digests()
    monkeypatch.setattr(media, "decode_all", lambda files: [(media.opened(f)[0][:, 1:].copy(), 3) for f in files])
    wrong = digests()
    assert all(right[i] != wrong[i] for i in range(8))


def test_broken_files_are_rows(spark):
    file = media.encode_png(media.padded(prose(300)))
    damaged = bytearray(file)
    damaged[60] ^= 255
    grey16 = bytearray(file)
    grey16[24] = 16
    grey16[29:33] = zlib.crc32(bytes(grey16[12:29])).to_bytes(4, "big")
    rows = [(1, file), (2, bytes(damaged)), (3, file[:-12]), (4, b"no picture"), (5, None), (6, b""), (7, bytes(grey16)), (1, file)]
    table = spark.createDataFrame(rows, "id long, media binary").withColumns({"feature": F.lit("clash"), "error": F.lit("clash"), "media_bytes": F.lit("clash")})
    got = sorted(media.read_media(table).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == [1, 1, 2, 3, 4, 5, 6, 7]
    assert got[0] == got[1] and got[0].error is None and got[0].payload_sha256
    assert all(r.error and r.payload_sha256 is None and r.feature is None for r in got if r.id in (2, 3, 4, 7))
    assert all(r.error is None and r.payload_bytes is None for r in got if r.id in (5, 6))


def test_feature_is_a_plain_cosine_transform():
    rows = np.frombuffer(media.padded(prose(2000, 3)), np.uint8).reshape(-1, 192)
    h, n, low = len(rows), 32, 8
    grey = [[sum(rows[y, 3 * x : 3 * x + 3].tolist()) / 3 for x in range(64)] for y in range(h)]
    tall = [[sum(grey[y][x] for y in range(h * i // n, h * (i + 1) // n)) / (h * (i + 1) // n - h * i // n) for x in range(64)] for i in range(n)]
    cells = [[(r[2 * j] + r[2 * j + 1]) / 2 for j in range(n)] for r in tall]
    cos = [[math.cos(math.pi * k * (2 * x + 1) / (2 * n)) for x in range(n)] for k in range(low)]
    part = [round(sum(cells[y][x] * cos[u][y] * cos[v][x] for y in range(n) for x in range(n)), 6) for u in range(low) for v in range(low)]
    middle = sorted(part[1:])[(len(part) - 1) // 2]
    bits = "".join(str(int(v > middle)) for v in part)
    assert h > n and media.cosine_hash(rows, 3) == f"{int(bits, 2):016x}"


def test_very_long_text(spark):
    text = "é long text \n" * 150_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.read_media(media.with_media(docs), payload=True).collect()}
    assert bytes(got[1].payload) == media.padded(text.encode()) and got[1].error is None
