"""File walks over many small files."""

from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from recallgrid.sources import transfer


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    found = transfer.walk(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 5 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
    assert sorted(r["text"] for r in found.select("text").collect()) == sorted(f"text {k}" for k in range(300))


TEXTS = [None, "", "a", "é\nü", "x" * 30, "two\n", "\ttab"] + [f"text {k}" for k in range(43)]


def read_back(folders):
    return {f: sorted(p.read_bytes() for p in Path(urlsplit(f).path).iterdir()) for f, _ in folders}


def test_tasks_write_a_file_for_each_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transfer, "FOLDER_FILES", 7)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    for k, path in enumerate((f"file://{tmp_path}/a b", f"{tmp_path}/plain")):
        folders = transfer.write_files(texts, path if k else path.replace(" ", "%20"))
        found = read_back(folders) if k else {f: sorted(p.read_bytes() for p in (tmp_path / "a b" / f.rpartition("/")[2]).iterdir()) for f, _ in folders}
        assert sorted(b for bs in found.values() for b in bs) == sorted(((t or "") + "\n").encode() for t in TEXTS)
        assert [len(found[f]) for f, _ in folders] == [n for _, n in folders] and max(n for _, n in folders) == 7
    assert not list(tmp_path.rglob("*.crc"))  # Hadoop's local file system, which starts processes for each file, has no part in it


def test_parts_are_walked_one_after_the_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transfer, "FOLDER_FILES", 7)
    monkeypatch.setattr(transfer, "LISTED_FILES", 20)
    folders = transfer.write_files(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3), f"file://{tmp_path}/tree")
    listed, plain = [], transfer.walk
    monkeypatch.setattr(transfer, "walk", lambda s, paths, **o: listed.append(paths) or plain(s, paths, **o))
    found = transfer.walk_parts(spark, folders, ["length", "left_out", "text"], most_bytes=20, listed=True)
    sizes = dict(folders)
    assert sorted(f for part in listed for f in part) == sorted(sizes) and len(listed) > 2 and all(sum(sizes[f] for f in part) <= 20 for part in listed)
    want = [(len(b := (t or "").encode()) + 1, None if len(b) < 20 else "large", (t or "") + "\n" if len(b) < 20 else None) for t in TEXTS]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_no_rows_and_other_stores(spark, tmp_path):
    none = transfer.write_files(spark.createDataFrame([], "text string"), f"file://{tmp_path}/none")
    assert transfer.walk_parts(spark, none, ["length", "text"]).collect() == []
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.walked.link./in", f"file://{tmp_path}/far")
    (tmp_path / "far").mkdir()
    folders = transfer.write_files(spark.createDataFrame([(t,) for t in TEXTS[:9]], "text string"), "viewfs://walked/in/tree")
    found = transfer.walk_parts(spark, folders, ["text"], ignore=["_SUCCESS", ".crc"])
    assert sorted(r["text"] for r in found.collect()) == sorted((t or "") + "\n" for t in TEXTS[:9])


def test_a_task_has_a_bounded_number_of_files(spark, tmp_path):
    """Thousands of files without a row in one task overflow the stack (walk_files at 1 GB: StackOverflowError)."""
    for k in range(3000):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        found = transfer.walk(spark, str(tmp_path), listed=True)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sum(sizes) == 3000 and max(sizes) <= transfer.TASK_FILES + 1
