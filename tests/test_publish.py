"""Verified publishing, streamed digests, the digest of repeated rows, and the bound evaluation protocol."""

import hashlib
import io
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import membership, protocol
from gridloom.sources import inventory, publish, sinks

TILE = "patch_id string, source string, month int, band int, values array<double>"


def tiles(spark, n=12, width=4):
    return spark.createDataFrame([(f"p{i}", "s2", 202401 + i % 2, 0, [float(i)] * width) for i in range(n)], TILE)


def files_of(staged):
    return sorted(Path(staged.root, staged.folder).rglob("*.parquet"))


def test_tiles_appear_when_they_are_published(spark, tmp_path):
    root = str(tmp_path / "shard")
    staged = publish.stage(tiles(spark), root, ["source", "month"], F.size("values") != 4)
    assert sum(r["rows"] for r in staged.files.collect()) == 12 and not publish.visible(spark, root)
    with pytest.raises(ValueError):
        publish.read_published(spark, root)
    publish.publish(staged, 12)
    for digests in (False, True):
        assert publish.read_published(spark, root, digests).count() == 12
    with pytest.raises(ValueError):
        sinks.write_tiles(tiles(spark), root, 12, 4)


@pytest.mark.parametrize("harm", ["removed", "damaged", "added"])
def test_a_harmed_file_stops_the_publish(spark, tmp_path, harm):
    root = str(tmp_path / "shard")
    staged = publish.stage(tiles(spark).coalesce(1), root, ["source", "month"], F.size("values") != 4)
    one = files_of(staged)[0]
    if harm == "removed":
        one.unlink()
    elif harm == "damaged":
        data = bytearray(one.read_bytes())
        data[len(data) // 2] ^= 1
        one.write_bytes(bytes(data))
    else:
        (one.parent / "part-extra.parquet").write_bytes(one.read_bytes())
    assert [r.problem for r in publish.problems(staged).collect()] == [{"removed": "missing"}.get(harm, harm)]
    with pytest.raises(ValueError):
        publish.publish(staged, 12)
    assert not publish.visible(spark, root)


def test_counts_and_sizes_stop_the_publish(spark, tmp_path):
    for i, (rows, expected) in enumerate(((tiles(spark), 13), (tiles(spark, width=3), 12))):
        with pytest.raises(ValueError):
            sinks.write_tiles(rows, str(tmp_path / f"s{i}"), expected, 4)
        assert not publish.visible(spark, str(tmp_path / f"s{i}"))


def test_a_published_file_that_changes_is_noticed(spark, tmp_path):
    root = str(tmp_path / "shard")
    staged = publish.stage(tiles(spark), root, ["source", "month"], F.size("values") != 4)
    publish.publish(staged, 12)
    one = files_of(staged)[0]
    data = bytearray(one.read_bytes())
    data[10] ^= 1
    one.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        publish.read_published(spark, root, digests=True)
    one.unlink()
    with pytest.raises(ValueError):
        publish.read_published(spark, root)


def test_digests_are_streamed(spark, tmp_path):
    for name, data in (("a b=1.bin", b"x" * 3_000_001), ("deep/é.bin", b""), ("deep/z.bin", b"abc")):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(data)
    got = {Path(r.path).name: (r.digest, r["size"]) for r in inventory.inventory(spark, str(tmp_path)).collect()}
    assert got["a b=1.bin"] == (hashlib.sha256(b"x" * 3_000_001).hexdigest(), 3_000_001)
    assert got["z.bin"] == (hashlib.sha256(b"abc").hexdigest(), 3) and len(got) == 3

    class Long(io.RawIOBase):
        """40 GB of zeros would do as well: no more than a chunk is asked for at a time."""

        left, asked = 1 << 24, 0

        def read(self, n=-1):
            assert 0 < n <= 1 << 16
            part = bytes(min(n, self.left))
            self.left -= len(part)
            return part

    assert inventory.streamed_digest(Long(), 1 << 16) == (hashlib.sha256(bytes(1 << 24)).hexdigest(), 1 << 24)


def test_digest_of_one_row_many_times(spark):
    rows = spark.range(10_000_000).select(F.lit("same").alias("a"))
    got = membership.content_digest(rows, ["a"]).first()
    one = hashlib.sha256(b'{"a":"same"}').hexdigest()
    assert (got.digest, got.n) == (hashlib.sha256(f"{one}x10000000".encode()).hexdigest(), 10_000_000)
    assert membership.content_digest(rows.limit(9_999_999), ["a"]).first().digest != got.digest


def pixels(spark):
    draw = np.random.default_rng(4)
    rows = [(p, i, [float(x) for x in v], int(v[0] > 0.2)) for p in range(30) for i, v in enumerate(draw.normal(size=(12, 4)))]
    rows = [(p, i, v, y if p % 3 else 0) for p, i, v, y in rows]  # every third patch has no positive pixel
    return spark.createDataFrame(rows, "patch_id int, pixel int, features array<double>, label int")


def test_probe_scores_only_what_it_was_learnt_on(spark, tmp_path):
    rows = pixels(spark)
    folds = spark.createDataFrame([(0, list(range(18)), list(range(18, 24)), list(range(24, 30)))], "fold int, train array<int>, val array<int>, test array<int>")
    for shot in (None, 3):
        root = str(tmp_path / f"probe{shot}")
        protocol.train(rows, folds, 0, root, shot=shot, seed=5)
        report = protocol.evaluate(rows.repartition(3), folds, root).first()
        assert report.test_rows == 72 and report.train_patches == (18 if shot is None else 6) and report.shot == shot
        harm = {
            "labels": (rows.withColumn("label", F.when((F.col("patch_id") == 29) & (F.col("pixel") == 0), 1 - F.col("label")).otherwise(F.col("label"))), folds),
            "dataset": (rows.withColumn("features", F.when((F.col("patch_id") == 29) & (F.col("pixel") == 0), F.array(*[F.lit(0.0)] * 4)).otherwise(F.col("features"))), folds),
            "folds": (rows, folds.withColumn("val", F.slice("val", 1, 5))),
        }
        for name, changed in harm.items():
            with pytest.raises(protocol.IdentityError) as refused:
                protocol.evaluate(*changed, root)
            assert refused.value.names == [name]
    with pytest.raises(ValueError):  # a patch in two splits
        protocol.train(rows, folds.withColumn("val", F.col("train")), 0, str(tmp_path / "leak"))
    with pytest.raises(ValueError):  # a patch without rows
        protocol.train(rows.where("patch_id < 29"), folds, 0, str(tmp_path / "absent"))
