"""Stored order: folders of differing files, row numbers, positional concat."""

import gzip
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sismo.operators.zipping import zip_stored
from sismo.sources import files as io


def folder(files):
    d = tempfile.mkdtemp(prefix="sismo-stored-")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        data = text.encode()
        with open(f"{d}/{name}", "wb") as f:
            f.write(gzip.compress(data) if name.endswith(".gz") else data)
    return d


def test_files_are_read_by_their_own_headers(spark):
    d = folder({"a.csv": "datetime,latitude,longitude,magnitude,depth\n2020-01-01,1,2,4.4,77\n",
                "b.csv": "depth,magnitude,longitude,latitude,datetime,agency\n77,4.4,2,1,2020-01-02,\"x, y\"\n",
                "c [1].csv": "\n\nagency,depth,magnitude,longitude,latitude,datetime,extra\nz,77,4.4,2,1,2020-01-03,e\n",
                "d.csv.gz": "magnitude,depth,latitude,longitude,datetime\n4.4,77,1,2,2020-01-04\n", "e.csv": "", "_hidden.csv": "x\n1\n"})
    rows = io.read_catalog(spark, d).orderBy("event_id").collect()
    assert [(r.magnitude, r.depth, r.latitude, r.longitude) for r in rows] == [(4.4, 77.0, 1.0, 2.0)] * 4
    assert [r.event_id for r in rows] == [0, 1, 2, 3] and [r.datetime.day for r in rows] == [1, 2, 3, 4]
    assert [(r.agency, r.extra) for r in rows] == [(None, None), ("x, y", None), ("z", "e"), (None, None)]
    assert io.read_preprocessed(spark, d).distinct().count() == 1


def test_folder_names_stay_columns_and_missing_columns_raise(spark):
    d = folder({"year=2020/a.csv": "datetime,latitude,longitude,magnitude,depth\n2020-01-01,1,2,4.4,77\n",
                "year=2021/a.csv": "depth,magnitude,longitude,latitude,datetime\n77,4.4,2,1,2021-01-02\n"})
    assert sorted((r.year, r.event_id) for r in io.read_catalog(spark, d).collect()) == [(2020, 0), (2021, 1)]
    with open(f"{d}/year=2021/b.csv", "w") as f:
        f.write("depth,magnitude,longitude,latitude\n77,4.4,2,1\n")
    with pytest.raises(io.MissingColumns, match="b.csv"):
        io.read_catalog(spark, d)


def test_files_without_ids_follow_the_largest_id(spark):
    d = folder({"a.csv": "event_id,datetime,latitude,longitude,magnitude,depth\n7,2020-01-01,1,2,4.4,77\nx,2020-01-01,1,2,4.4,78\n",
                "b.csv": "datetime,latitude,longitude,magnitude,depth\n2020-01-01,1,2,4.4,79\n2020-01-01,1,2,4.4,80\n"})
    assert {(r.depth, r.event_id) for r in io.read_catalog(spark, d).collect()} == {(77.0, 7), (78.0, None), (79.0, 10), (80.0, 11)}


def test_ids_follow_the_files_whatever_the_split_size(spark):
    rnd = random.Random(3)
    head = ["datetime", "latitude", "longitude", "magnitude", "depth", "note"]
    files, n = {}, 0
    for k in range(5):
        order = rnd.sample(head, len(head)) if k % 2 else head
        lines = [",".join(order)]
        for _ in range(rnd.choice([1, 50, 4000])):
            row = {"datetime": "2020-01-01", "latitude": "1", "longitude": "2", "magnitude": "3", "depth": "4", "note": str(n)}
            lines.append(",".join(row[c] for c in order))
            n += 1
        files[f"part-{k}.csv"] = "\n".join(lines) + "\n"
    d = folder(files)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("128m", "4m"), ("20k", "1k"), ("7k", "7k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = io.read_catalog(spark, d).select("event_id", F.col("note").cast("long").alias("note")).collect()
            assert len(rows) == n and all(r.event_id == r.note for r in rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_parquet_catalogue_gets_ids_in_stored_order(spark):
    d = tempfile.mkdtemp(prefix="sismo-stored-") + "/p"
    df = spark.range(0, 500, numPartitions=4).selectExpr("id as note", "timestamp_ntz'2020-01-01' as datetime", "1d as latitude", "2d as longitude", "3d as magnitude", "4d as depth")
    df.write.parquet(d)
    rows = io.read_catalog(spark, d, "parquet").collect()
    assert len(rows) == 500 and all(r.event_id == r.note for r in rows)


def stored(spark, df, parts):
    d = tempfile.mkdtemp(prefix="sismo-stored-") + "/t"
    df.repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(d)
    return d


@pytest.mark.parametrize("size", [7, 1000])
def test_zip_of_two_layouts(spark, size):
    df = spark.range(1003).selectExpr("id", "array(id, id + 1) as pair", "if(id % 7 = 0, null, concat('é', id)) as text")
    left, right = stored(spark, df.select("id", "text"), 5), stored(spark, df.selectExpr("id as other", "pair", "id").drop("id").selectExpr("other as id", "pair"), 3)
    with pytest.raises(ValueError, match="both sides"):
        zip_stored(spark, left, right)
    right = tempfile.mkdtemp(prefix="sismo-stored-") + "/r"
    df.repartitionByRange(3, "id").sortWithinPartitions("id").selectExpr("id as other", "pair").write.parquet(right)
    rows = zip_stored(spark, left, right, size).collect()
    assert len(rows) == 1003 and all(r.id == r.other == r.pair[0] and r.text == (None if r.id % 7 == 0 else f"é{r.id}") for r in rows)


def test_zip_of_unequal_and_empty_tables(spark):
    df = spark.range(10)
    a, b, e, f = (stored(spark, x, 2) for x in (df, df.limit(9), df.limit(0), df.limit(0)))
    two = tempfile.mkdtemp(prefix="sismo-stored-")
    for n, p in (("b", b), ("f", f)):
        spark.read.parquet(p).withColumnRenamed("id", "other").coalesce(1).write.parquet(f"{two}/{n}")
    with pytest.raises(ValueError, match="10 rows"):
        zip_stored(spark, a, f"{two}/b")
    out = zip_stored(spark, e, f"{two}/f")
    assert out.columns == ["id", "other"] and out.collect() == []
