"""The data source: the same sections in batch and as a stream, planned by bytes, filtered by path, bad files as rows."""

import os

import pytest
from pyspark.sql import functions as F

from loomcorpus.sources import rst
from loomcorpus.sources.format import Folder, SectionSource

PAGE = "Title {0}\n=======\n\nText of {0}.\n\nPart\n----\n\nMore of {0}.\n"


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(SectionSource)
    at = tmp_path / "docs"
    (at / "sub").mkdir(parents=True)
    (at / "_templates").mkdir()
    for i in range(6):
        (at / ("sub" if i % 2 else "") / f"f{i}.rst").write_text(PAGE.format(i))
    (at / "_templates/t.rst").write_text(PAGE.format("t"))
    (at / "template.rst").write_text("{{ x }} {% y %}")
    (at / "other.txt").write_text("no")
    return at


def rows_of(df):
    return sorted((r["original_path"], r["doc_ord"], r["text"], tuple(r["section_hierarchy"] or ())) for r in df.collect())


def run(spark, folder, out):
    q = spark.readStream.format("sections").load(str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(out))


def test_batch_and_stream_give_equal_sections(spark, folder, tmp_path):
    batch = spark.read.format("sections").load(str(folder))
    got = rows_of(batch)
    assert len(got) == 12 and got[0] == ("f0.rst", 0, "Text of 0.", ("Title 0",)) and got[1][3] == ("Title 0", "Part")
    assert sorted(x[2:] for x in got) == sorted((r["text"], tuple(r["section_hierarchy"])) for r in rst.read_rst(spark, str(folder)).collect())
    out = tmp_path / "out"
    assert rows_of(run(spark, folder, out)) == got
    (folder / "sub/late.rst").write_text(PAGE.format("l"))
    for _ in range(2):
        after = run(spark, folder, out)
        assert after.count() == 14 and after.filter("original_path = 'sub/late.rst'").count() == 2
    os.utime(folder / "f0.rst", (4e9, 4e9))
    again = run(spark, folder, out)
    assert again.count() == 16 and again.filter("original_path = 'f0.rst'").select("delivery").distinct().count() == 2


def test_partitions_filters_and_bad_files(spark, folder):
    (folder / "bad.html").write_text("<div>" * 3000 + "x")
    reader = spark.read.format("sections").option("partition_bytes", 120)
    assert reader.load(str(folder)).rdd.getNumPartitions() >= 3
    sizes = Folder({"path": f"file://{folder}", "partition_bytes": "120"})
    assert all(len(p.files) == 1 or sum(f.size for f in p.files) <= 120 for p in sizes.planned(sizes.list()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("sections").option("push", "true").load(str(folder)).filter(F.col("original_path").startswith("sub/") & (F.col("doc_ord") == 1))
        assert [x[0] for x in rows_of(some)] == ["sub/f1.rst", "sub/f3.rst", "sub/f5.rst"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (folder / "f1.rst").symlink_to(folder / "nowhere")
    (folder / "f2.rst").chmod(0o000)
    found = spark.read.format("sections").load(str(folder))
    assert {r["original_path"] for r in found.filter("problem IS NOT NULL").collect()} <= {"f1.rst", "f2.rst"} and found.filter("text IS NOT NULL").count() >= 10
    assert spark.read.format("sections").option("kind", "html-headings").load(str(folder)).count() <= 1
