import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from framewise.sources import files
from framewise.sources.stages import StageStore, file_state


def test_missing_tokens_bom_and_line_ends(spark, tmp_path, values):
    path = tmp_path / "in.csv"
    path.write_bytes(
        b'\xef\xbb\xbfObject,object.corrected,check again\r\n'
        b'cup,NA,1\r\nstick , ,NA\r\n"a, b","",0\r\nNA,spoon,'
    )
    schema = files.schema(item="string", new_item="string", check="int")
    out = files.read_annotations(spark, str(path), schema)
    assert values(out) == [
        ("a, b", None, 0), ("cup", None, 1), ("stick", None, None), (None, "spoon", None),
    ]


def test_csv_writes_missing_as_token(spark, tmp_path, make, values):
    df = make("item string, n int", ("a, b", 1), (None, None))
    path = str(tmp_path / "out")
    assert files.write_table(df.coalesce(1), path, "csv").columns == ["item", "n"]
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert "NA,NA" in text and text.startswith("item,n")
    assert values(files.read_annotations(spark, path, files.schema(item="string", n="int"))) == values(df)


def test_columns_bind_by_name_in_any_order(spark, tmp_path, values):
    path = tmp_path / "in.csv"
    path.write_text("hour,note, Subject \n7,x,1\n8.0,y,2.\nNA,z,\n")
    layout = files.schema(subject="long", hour="int")
    assert values(files.read_annotations(spark, str(path), layout)) == [(1, 7), (2, 8), (None, None)]
    with pytest.raises(ValueError, match="does not fit"):
        files.read_annotations(spark, str(path), files.schema(subject="long", day="int"))
    with pytest.raises(ValueError, match="does not fit"):
        files.read_annotations(spark, str(path), files.schema(a="long", b="int"))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("subject,hour\n1,7\n")
    (tmp_path / "b.csv").write_text("hour,subject\n7,1\n")
    with pytest.raises(Exception, match="does not conform"):
        files.read_annotations(spark, str(tmp_path), files.schema(subject="long", hour="int")).collect()


def test_bad_fields_are_told_and_counted(spark, tmp_path, values):
    path = tmp_path / "in.csv"
    path.write_text("n,x\n1,2.5\nabc,1\n1.5,z\n,\n")
    layout = files.schema(n="long", x="double")
    seen = Observation()
    out = files.read_annotations(spark, str(path), layout, bad="wrong", observe=seen)
    assert values(out) == [(1, 2.5, None), (None, 1.0, "n: abc"), (None, None, "n: 1.5; x: z"), (None, None, None)]
    assert seen.get == {"rows": 4, "bad_rows": 2}
    with pytest.raises(Exception, match="n: abc|n: 1.5"):
        files.read_annotations(spark, str(path), layout).collect()
    assert files.read_annotations(spark, str(path), layout).select("x").count() == 4


def test_line_breaks_in_quotes_on_request_and_split_reading(spark, tmp_path, values):
    path = tmp_path / "in.csv"
    path.write_text('item,n\n"a\nb",1\n')
    layout = files.schema(item="string", n="int")
    assert values(files.read_annotations(spark, str(path), layout, multiline=True)) == [("a\nb", 1)]
    path.write_text("item,n\n" + "".join(f"x{i},{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = files.read_annotations(spark, str(path), layout)
        assert out.rdd.getNumPartitions() > 5 and out.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_time_of_day(make, values):
    out = make("t string", ("12:34:56",), ("25:00:00",), (None,)).select(F.hour(files.time_of_day(F.col("t"))).alias("h"))
    assert values(out) == [(12,), (None,), (None,)]


def test_publishing_runs_the_plan_once_and_replaces_whole(spark, tmp_path, make):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    path = str(tmp_path / "out")
    assert files.publish(make("a int", (1,), (2,)).mapInArrow(count, "a int"), path) == 2 and runs.value == 2
    assert files.publish(make("a int", (3,)), path) == 1 and [r.a for r in spark.read.parquet(path).collect()] == [3]
    assert files.publish(make("a int", (3,)).where("a > 3"), path) == 0 and spark.read.parquet(path).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    files.remove(spark, path)
    assert not list(tmp_path.iterdir())


def test_stages_resume_after_the_last_whole_one(spark, tmp_path, make, values):
    store, built = StageStore(spark, str(tmp_path)), []

    def numbers():
        built.append("numbers")
        return make("a int", (1,), (2,))

    def doubled(df):
        built.append("doubled")
        return df.withColumn("a", F.col("a") * 2)

    def run(factor=2):
        first = store.stage("numbers", numbers)
        return store.stage("doubled", doubled, [first], {"factor": factor})

    assert values(run().table) == [(2,), (4,)] and built == ["numbers", "doubled"]
    assert values(run().table) == [(2,), (4,)] and built == ["numbers", "doubled"] and not run().computed
    assert run(3).computed and built == ["numbers", "doubled", "doubled"]
    # a stage whose manifest is missing was not finished
    (folder,) = [p for p in tmp_path.glob("numbers-*")]
    for f in [*(folder / "manifest").iterdir()]:
        f.unlink()
    (folder / "manifest").rmdir()
    make("a int", (99,)).write.mode("overwrite").parquet(str(folder / "data"))
    assert store.stage("numbers", numbers).computed and values(store.stage("numbers", numbers).table) == [(1,), (2,)]
    # other files, another key
    path = tmp_path / "in.txt"
    path.write_text("x")
    before = file_state(spark, str(path))
    path.write_text("xy")
    assert before != file_state(spark, str(path)) and before[0][1] == 1


def test_write_only_if_any(tmp_path, make):
    df = make("a int", (1,))
    assert files.write_if_any(df, str(tmp_path / "yes"))
    assert not files.write_if_any(df.where("a > 1"), str(tmp_path / "no"))
    assert (tmp_path / "yes").exists() and not (tmp_path / "no").exists()


def test_partitioned_parquet_prunes(spark, tmp_path, make):
    df = make("site string, n int", ("A", 1), ("B", 2))
    path = str(tmp_path / "p")
    files.write_table(df, path, by=["site"])
    back = spark.read.parquet(path).where("site = 'A'")
    assert [r["n"] for r in back.collect()] == [1]
    assert "PartitionFilters: [isnotnull(site" in back._jdf.queryExecution().toString()


def test_scratch_folder_is_below_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = files.scratch_folder(spark, "x"), files.scratch_folder(spark, "x")
    assert one.startswith(root) and one != two
