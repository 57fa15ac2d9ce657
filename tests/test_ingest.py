import os

import pytest
from pyspark.sql import functions as F

from quern.sources import catalog as S
from quern.sources import ingest as I
from quern.sources import versions as Vs

SCHEMA = "filename string, version long, x long"


def rows(df):
    return sorted((r["filename"], r["version"], r["x"]) for r in df.collect())


def test_latest_row_of_each_key_by_buckets(spark, tmp_path):
    path = str(tmp_path / "catalog")
    assert I.upsert_version(spark.createDataFrame([], SCHEMA), path) is None and I.read_version(spark, path, SCHEMA).count() == 0
    assert I.upsert_version(spark.createDataFrame([(f"f{i}", 1, i) for i in range(50)], SCHEMA), path, buckets=8) == 0
    before = Vs.current(spark, path)
    new = spark.createDataFrame([("f3", 2, 100), ("f4", 0, 101), ("f5", 1, 102), ("g", 7, 103)], SCHEMA)
    assert I.upsert_version(new, path, buckets=8) == 1
    want = {f"f{i}": (1, i) for i in range(50)} | {"f3": (2, 100), "f5": (1, 102), "g": (7, 103)}
    assert rows(I.read_version(spark, path, SCHEMA)) == sorted((k, *v) for k, v in want.items())
    after = Vs.current(spark, path)
    assert 1 <= sum(after.get(b) != f for b, f in before.items()) <= 4  # other buckets are not written again
    assert I.upsert_version(new, path, buckets=8) == 2 and rows(I.read_version(spark, path, SCHEMA)) == sorted((k, *v) for k, v in want.items())
    assert [r["id"] for r in I.with_ids(I.read_version(spark, path, SCHEMA)).orderBy("filename").collect()] == list(range(51))
    assert Vs.vacuum(spark, path, 1) >= 1 and rows(I.read_version(spark, path, SCHEMA)) == sorted((k, *v) for k, v in want.items())


def test_readers_never_see_half_an_index(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    order = one.selectExpr("0L pos", "vec_id")
    S.save_index(order, one, path)
    # a writer that dies after its data, and one that dies while it commits
    order.join(one, "vec_id").write.parquet(Vs.new_folder(path))
    (tmp_path / "index" / "_versions" / "1").write_text("index\tdata-none\n")
    assert [r["vec_id"] for r in S.load_index(spark, path).collect()] == [1]
    with pytest.raises(FileExistsError):
        Vs.commit(spark, path, {}, 0)
    two = one.withColumn("vec_id", F.lit(2).cast("long"))
    assert S.save_index(two.selectExpr("0L pos", "vec_id"), two, path) == 2
    assert [r["vec_id"] for r in S.load_index(spark, path).collect()] == [2]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path, commit, other = str(tmp_path / "catalog"), Vs.commit, []

    def second(s, p, parts, after):
        if not other:
            other.append(1)
            I.upsert_version(spark.createDataFrame([("b", 1, 2)], SCHEMA), path)
        return commit(s, p, parts, after)

    monkeypatch.setattr(Vs, "commit", second)
    I.upsert_version(spark.createDataFrame([("a", 1, 1)], SCHEMA), path)
    assert rows(I.read_version(spark, path, SCHEMA)) == [("a", 1, 1), ("b", 1, 2)]


@pytest.mark.parametrize("die", ["before", "after"])
def test_a_killed_ingest_takes_each_file_once(spark, tmp_path, monkeypatch, die):
    folder, path, state = tmp_path / "in", str(tmp_path / "catalog"), str(tmp_path / "state")
    folder.mkdir()
    for i in range(5):
        (folder / f"p{i}.jpg").write_bytes(bytes([16 * i] * 10))
    (folder / "notes.txt").write_text("no image")
    commit, calls = Vs.commit, []

    def dying(*args):
        calls.append(1)
        if len(calls) == 2 and die == "before":
            raise RuntimeError("killed")
        number = commit(*args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return number

    monkeypatch.setattr(Vs, "commit", dying)
    start = lambda: I.ingest_images(spark, str(folder), path, state, S.byte_histogram, 4, 2).awaitTermination()
    with pytest.raises(Exception, match="killed"):
        start()
    monkeypatch.setattr(Vs, "commit", commit)
    start()
    schema = "filename string, features array<float>, version timestamp"
    found = lambda: sorted((os.path.basename(r["filename"]), max(range(16), key=r["features"].__getitem__)) for r in I.read_version(spark, path, schema).collect())
    assert found() == [(f"p{i}.jpg", i) for i in range(5)]
    number = Vs.last(spark, path)
    start()
    assert Vs.last(spark, path) == number  # nothing new, nothing written
    (folder / "p9.jpg").write_bytes(bytes([16 * 9] * 10))
    start()
    assert found() == [*[(f"p{i}.jpg", i) for i in range(5)], ("p9.jpg", 9)]


def test_stages_go_at_the_end_of_their_scope(spark):
    from quern import stages

    outer = stages.stored(spark.range(3), "outer")
    with stages.scope():
        inner = stages.stored(spark.range(4), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.count() == 4
    assert not os.path.exists(path) and outer.count() == 3


@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path, folder):
    import pandas as pd

    from quern.plans import queries as Q

    at = tmp_path / "pages.parquet"
    if folder:
        at.mkdir()
    rows = [(i, f"u{i % 7}", "") for i in range(20)]
    for k in (0, 1) if folder else (0,):
        part = rows[k::2] if folder else rows
        pd.DataFrame(part, columns=["page_id", "url", "html"]).to_parquet(at / f"part-{k}.parquet" if folder else at)
    got = {r["url"]: r["page_id"] for r in Q.queries()["stream_ingest"](spark, str(tmp_path)).collect()}
    assert got == {u: max(i for i, v, _ in rows if v == u) for u in {u for _, u, _ in rows}}
