import json
import os

import numpy as np
import pytest

from quern.plans import config as Cf
from quern.plans.save import save

LABELS = [1, 1, None, 2, 2, 2, None]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder, x = tmp_path_factory.mktemp("in"), np.random.default_rng(1).normal(size=(7, 3))
    for i in range(7):
        (folder / f"p{i}.jpg").write_bytes(bytes([i]))
    df = spark.createDataFrame([(i, f"{folder}/p{i}.jpg", v) for i, v in enumerate(x.tolist())], "vec_id long, path string, embedding array<double>").cache()
    return df, spark.createDataFrame(list(enumerate(LABELS)), "vec_id long, cluster_id long").cache(), x


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read()[0] for d, _, names in os.walk(folder) for f in names}


def test_folders_of_copies_and_unclustered(files, tmp_path):
    df, assign, _ = files
    save(df, assign, Cf.Clustering(), str(tmp_path / "a"))
    assert tree(tmp_path / "a/files") == {f"cluster_{c:03d}/p{i}.jpg" if c else f"unclustered/p{i}.jpg": i for i, c in enumerate(LABELS)}
    save(df, assign, Cf.Clustering(naming="distance", save_discarded=False), str(tmp_path / "b"))
    found = tree(tmp_path / "b/files")
    assert sorted(found.values()) == [0, 1, 3, 4, 5] and all(name[3] == "-" and "/00" in name for name in found)


def test_groups_have_plain_names(files, tmp_path):
    df, assign, _ = files
    save(df, assign, Cf.Clustering(save_mode="group_filling", group_filling_size=3), str(tmp_path))
    found = tree(tmp_path / "files")
    assert sorted(found.values()) == list(range(7)) and all(name == f"{int(name[:6]):06d}_{LABELS[i] or 0}_p{i}.jpg" for name, i in found.items())
    assert sorted(int(n[:6]) for n in found) == list(range(7))


def test_documents_by_file_number(spark, files, tmp_path):
    df, assign, x = files
    save(df, assign, Cf.Clustering(save_mode="json", naming="distance_plus"), str(tmp_path))
    docs = {r["cluster_id"]: json.loads(r["document"]) for r in spark.read.parquet(str(tmp_path / "clusters")).collect()}
    number = {os.path.basename(r["path"]): r["file_id"] for r in spark.read.parquet(str(tmp_path / "files")).collect()}
    assert number == {"p0.jpg": 1, "p1.jpg": 2, "p3.jpg": 3, "p4.jpg": 4, "p5.jpg": 5}
    assert docs[2]["size"] == 3 and [i["file_id"] for i in docs[2]["items"]] == [3, 4, 5] and docs[2]["items"][0]["file_name"].endswith(".jpg")
    assert docs[2]["pairwise_distances"]["3"]["5"] == pytest.approx(np.linalg.norm(x[3] - x[5]), abs=1e-6) and "3" not in docs[2]["pairwise_distances"]["3"]
    save(df, assign, Cf.Clustering(save_mode="print"), str(tmp_path))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == 7 and sum(line.startswith("cluster_") for line in lines) == 2
