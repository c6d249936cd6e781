import hashlib
import zlib

from lineaspark.llm import media
from lineaspark.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, media string, member string, error int"
TEXTS = ["abc", "abc", "", None, "é😀\x00" * 40, "x" * 64, "y" * 65, "\0" * 128, "long " * 100_000]


def test_round_trip_of_all_rows(spark):
    rows = [(k, t, "m", "n", 0) for k, t in enumerate(TEXTS)] + [(None, "no id", "", "", 0), (0, "again", "", "", 0)]
    got = media.media_columns(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        pad = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        want.append((str(i), len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in got) == sorted(want)
    by = {}
    for r in got:
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.error is None
        by.setdefault(r.payload_sha256 + str(r.n_bytes), set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).collect() == []
    texts = [("a/b.c=", "x"), ("", "y"), (None, "z"), ("é.1.png", None), ("-", "-"), ("a/b.c=", "x")]
    got = media.media_columns(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    digest = lambda t: hashlib.sha256((t or "").encode().ljust(64, b"\0")).hexdigest()
    assert sorted((str(r.doc_id), r.payload_sha256) for r in got) == sorted((str(i), digest(t)) for i, t in texts)


def test_image_is_lossless_and_damage_is_noticed():
    payload = media.payload_of("some text " * 30)
    image = media.to_png(payload, 300)
    assert media.from_png(image) == (payload, 300)
    for at in (20, 60, len(image) - 20):
        bad = image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :]
        try:
            assert media.from_png(bad) == (payload, 300) and False
        except (ValueError, zlib.error):
            pass


def test_ranges_cover_members_once_and_retries_are_by_member(spark):
    scratch = Scratch(spark, "t")
    rows = [(k, f"text {k} " * 50, "", "", 0) for k in range(200)]
    scratch.table(media.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{scratch.base}/a", archive_bytes=20_000), "manifest")
    manifest = f"{scratch.base}/manifest"
    back = media.read(spark, manifest, range_bytes=3000)
    assert back.count() == 200 and back.rdd.getNumPartitions() > 10
    assert back.select("archive").distinct().count() > 1
    assert media.read(spark, manifest, range_bytes=3000, partitions=4).rdd.getNumPartitions() <= 4
    assert sorted(r.member for r in media.read(spark, manifest, partitions=4).collect()) == sorted(r.member for r in back.collect())

    class Flaky(media.MemberReader):
        calls: dict = {}

        def fetch(self, file, at, size):
            n = self.calls[at] = self.calls.get(at, 0) + 1
            if at % 7 == 0 and n == 1:
                raise OSError("lost")
            if at == self.dead:
                raise OSError("gone")
            return super().fetch(file, at, size)

    reader = Flaky({"manifest": manifest})
    part = reader.partitions()[0]
    plain = [r for b in media.MemberReader({"manifest": manifest}).read(part) for r in b.to_pylist()]
    reader.dead = plain[3]["record_at"]
    got = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["member"] for r in got] == [r["member"] for r in plain]
    for r, p in zip(got, plain, strict=True):
        if r["record_at"] == reader.dead:
            assert (r["media"], r["error"], r["attempts"]) == (None, "gone" if reader.dead % 7 or r["attempts"] > 1 else "lost", 3)
        else:
            assert r["media"] == p["media"] and r["attempts"] == (2 if r["record_at"] % 7 == 0 else 1)


def test_planning_reads_footers_and_covers_every_split(spark, monkeypatch):
    scratch = Scratch(spark, "t")
    rows = [(k, f"text {k} " * (k % 90), "", "", 0) for k in range(300)]
    manifest = f"{scratch.base}/manifest"
    media.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{scratch.base}/a", archive_bytes=9000, stretch_bytes=1500).write.option("parquet.block.size", 1).parquet(manifest)
    stretches = spark.read.parquet(manifest).count()
    reads = []
    whole = media.pq.ParquetFile.read_row_group
    monkeypatch.setattr(media.pq.ParquetFile, "read_row_group", lambda self, g, **k: reads.append(g) or whole(self, g, **k))
    want = sorted(m["member"] for r in spark.read.parquet(manifest).collect() for m in r.places)
    for step, most in ((1 << 20, 100_000), (400, 100_000), (400, 7), (1 << 20, 1), (1, 50)):
        reader = media.MemberReader({"manifest": manifest, "range_bytes": step, "partitions": most})
        parts = reader.partitions()
        assert not reads and 1 <= len(parts) <= most and (step < 1 << 20 or most < 9 or len(parts) == stretches)
        assert sorted(m["member"] for p in parts for piece in p.pieces for _, ms in reader.places(piece) for m in ms) == want
        reads.clear()
