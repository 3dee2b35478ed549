"""Documents as files: exact names, nothing left of failed jobs, replays without duplicates."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from matchlens.sources import document_files as files


def contents(path):
    return {n: (path / n).read_text() for n in sorted(os.listdir(path))}


def documents(spark, first, n):
    return spark.range(first, first + n, 1, 4).select(F.concat(F.lit("profile_"), "id", F.lit(".txt")).alias("filename"),
                                                      F.concat(F.lit("first line of "), "id", F.lit("\nsecond\n")).alias("document"))


def test_each_document_is_a_file_of_its_name(spark, tmp_path):
    files.write_files(documents(spark, 0, 50), str(tmp_path / "out"))
    found = contents(tmp_path / "out")
    assert found == {f"profile_{k}.txt": f"first line of {k}\nsecond\n" for k in range(50)}
    files.write_files(documents(spark, 48, 4), f"file://{tmp_path}/out", "append")
    assert sorted(contents(tmp_path / "out")) == sorted(f"profile_{k}.txt" for k in range(52))
    files.write_files(documents(spark, 7, 2), str(tmp_path / "out"))
    assert sorted(contents(tmp_path / "out")) == ["profile_7.txt", "profile_8.txt"]


@pytest.mark.parametrize("bad", ["../up.txt", "", ".hidden", None])
def test_a_failed_job_leaves_everything_as_it_was(spark, tmp_path, bad):
    out = tmp_path / "out"
    files.write_files(documents(spark, 0, 3), str(out))
    named = documents(spark, 10, 40).withColumn("filename", F.when(F.col("filename") == "profile_49.txt", F.lit(bad)).otherwise(F.col("filename")))
    with pytest.raises(PySparkException):
        files.write_files(named, str(out))
    assert sorted(contents(out)) == ["profile_0.txt", "profile_1.txt", "profile_2.txt"]


def test_stream_and_replay(spark, tmp_path):
    files.register(spark)
    (tmp_path / "in").mkdir()
    for checkpoint in ("one", "two"):                    # the second query reads everything again: the same files
        for k in range(2):
            documents(spark, 3 * k, 3).write.mode("overwrite").json(str(tmp_path / f"in/part{k}"))
        stream = spark.readStream.schema("filename string, document string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        query = (stream.writeStream.format(files.FORMAT).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint))
                 .trigger(availableNow=True).start())
        assert query.awaitTermination(120) and query.exception() is None
        assert contents(tmp_path / "out") == {f"profile_{k}.txt": f"first line of {k}\nsecond\n" for k in range(6)}


def test_no_documents_and_wrong_columns(spark, tmp_path):
    files.write_files(documents(spark, 0, 0), str(tmp_path / "out"))
    assert contents(tmp_path / "out") == {}
    files.register(spark)
    with pytest.raises(PySparkException):
        spark.range(1).write.format(files.FORMAT).mode("append").option("path", str(tmp_path / "out")).save()
