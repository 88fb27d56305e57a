"""The store of releases, and digests of files of any size."""

import hashlib
import random

import pytest

from tidecast.operators import govern, series
from tidecast.sources import vintages

ROWS = "indicator string, t long, value double"


def rows(spark, *xs):
    return spark.createDataFrame(list(xs), ROWS)


@pytest.fixture
def store(tmp_path):
    return f"file://{tmp_path}/store"


def as_of(spark, store, vintage=None):
    return {(r.indicator, r.t): (r.value, r.vintage, r.number) for r in vintages.read_as_of(spark, store, vintage).collect()}


def test_releases_are_added_and_read_as_of(spark, store):
    assert vintages.releases(spark, store).count() == 0 and as_of(spark, store) == {}
    first = rows(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None))
    assert vintages.publish(first, store, "2024-01", "bureau", "a.csv", "aa", "first") == 1
    assert vintages.publish(rows(spark, ("a", 2, 2.5), ("a", 3, 3.0)), store, "2024-03", "bureau", "a2.csv", "bb") == 2
    assert vintages.publish(rows(spark, ("b", 1, 9.0)), store, "2024-02", "office", "b.csv", "cc") == 3
    assert as_of(spark, store, "2023-12") == {}
    assert as_of(spark, store, "2024-01") == {("a", 1): (1.0, "2024-01", 1), ("a", 2): (2.0, "2024-01", 1), ("b", 1): (None, "2024-01", 1)}
    assert as_of(spark, store, "2024-02")["b", 1] == (9.0, "2024-02", 3)
    assert as_of(spark, store) == {("a", 1): (1.0, "2024-01", 1), ("a", 2): (2.5, "2024-03", 2), ("a", 3): (3.0, "2024-03", 2), ("b", 1): (9.0, "2024-02", 3)}
    (row,) = vintages.read_as_of(spark, store).where("indicator = 'b'").collect()
    assert (row.source, row.file, row.sha256, row.notes) == ("office", "b.csv", "cc", "")


def test_a_re_release_is_a_vintage(spark, store):
    same = rows(spark, ("a", 1, 1.0))
    for k in (1, 2):
        assert vintages.publish(same, store, "2024-01", "bureau", "a.csv", "aa") == k
    assert as_of(spark, store) == {("a", 1): (1.0, "2024-01", 2)}
    vintages.publish(rows(spark, ("a", 1, None)), store, "2024-02", "bureau", "a.csv", "bb", "withdrawn")
    assert as_of(spark, store) == {("a", 1): (None, "2024-02", 3)} and as_of(spark, store, "2024-01")["a", 1][0] == 1.0
    got = [(r.vintage, r.value, r.was) for r in series.revisions(vintages.history(spark, store)).collect()]
    assert got == [("2024-02", None, 1.0)]


def test_an_interrupted_write_shows_nothing(spark, store):
    vintages.publish(rows(spark, ("a", 1, 1.0)), store, "2024-01", "bureau", "a.csv", "aa")
    folder, n = vintages.stage(rows(spark, ("a", 1, 7.0)), store)  # and then the writer dies
    vintages._put(spark, f"{store}/log/.draft-0", "half a")
    assert as_of(spark, store)["a", 1][0] == 1.0 and vintages.releases(spark, store).count() == 1
    assert vintages.commit(spark, store, folder, n, "2024-02", "bureau", "a.csv", "bb") == 2
    assert as_of(spark, store)["a", 1][0] == 7.0


def test_two_writers_take_two_numbers(spark, store, monkeypatch):
    """Both saw the same log; the later one finds its number taken and goes on."""
    vintages.publish(rows(spark, ("a", 1, 1.0)), store, "v1", "s", "f", "x")
    folder, n = vintages.stage(rows(spark, ("a", 1, 2.0)), store)
    real, seen = vintages._numbers, []

    def stale(*a):
        got = real(*a)
        if not seen:
            seen.append(1)
            vintages.publish(rows(spark, ("a", 1, 3.0)), store, "v2", "s", "f", "y")
        return got

    monkeypatch.setattr(vintages, "_numbers", stale)
    assert vintages.commit(spark, store, folder, n, "v3", "s", "f", "z") == 3
    assert sorted((r.number, r.vintage) for r in vintages.releases(spark, store).collect()) == [(1, "v1"), (2, "v2"), (3, "v3")]


def test_manifest_reads_files_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(govern, "PIECE", 1000)
    rnd = random.Random(1)
    want = {}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, size in (("empty.bin", 0), ("one.bin", 1), ("even.bin", 3000), ("deep/odd.bin", 12_345), ("deep/er/with space é.csv", 999)):
        data = rnd.randbytes(size)
        (tmp_path / name).write_bytes(data)
        want[name.rsplit("/", 1)[-1]] = (size, hashlib.sha256(data).hexdigest())
    got = {r.file: (r.bytes, r.sha256) for r in govern.manifest(spark, f"file://{tmp_path}").collect()}
    assert got == want
    assert {r.file for r in govern.manifest(spark, str(tmp_path), "*.csv").collect()} == {"with space é.csv"}


def test_manifest_of_a_large_sparse_file(spark, tmp_path):
    """A file over 2 GB, which no binary value could hold; it takes no disk."""
    size = (2 << 30) + 17
    with (tmp_path / "large.bin").open("wb") as f:
        f.seek(size - 1)
        f.write(b"x")
    got = govern.manifest(spark, str(tmp_path)).first()
    digest = hashlib.sha256()
    with (tmp_path / "large.bin").open("rb") as f:
        while piece := f.read(1 << 22):
            digest.update(piece)
    assert (got.bytes, got.sha256) == (size, digest.hexdigest())
