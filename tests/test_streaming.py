"""Results as a stream against the same results as a table."""

from tessera.streaming import results


def rows(a, b):
    return [(f"p{i}", "Web" if i % 3 else "web", 100 + i, i * 7 % 50, i * 5 % 50, 3, 1, 2, 3, int(i % 10 == 0), "2024-01-01 00:00:00") for i in range(a, b)]


def test_summary_follows_new_files(spark, tmp_path):
    names = [f.split()[0] for f in results.RESULT.split(", ")]
    write = lambda part, name: spark.createDataFrame(part, names).coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / name))
    write(rows(0, 40), "one")
    for i, extra in enumerate((None, rows(40, 90))):
        if extra:
            write(extra, "two")
        stream = results.summary(results.read(spark, str(tmp_path / "in/*")))
        results.start(stream, f"seen{i}", str(tmp_path / "state") if not i else str(tmp_path / "again")).awaitTermination()
        table = spark.read.schema(results.RESULT).option("header", True).csv(str(tmp_path / "in/*"))
        assert sorted(map(str, spark.table(f"seen{i}").collect())) == sorted(map(str, results.summary(table).collect()))
        assert spark.table(f"seen{i}").count() == 1


def test_repeated_results_count_once(spark, tmp_path):
    names = [f.split()[0] for f in results.RESULT.split(", ")]
    spark.createDataFrame(rows(0, 30) + rows(10, 20), names).write.option("header", True).csv(str(tmp_path / "in"))
    stream = results.once(results.read(spark, str(tmp_path / "in")))
    results.start(stream, "unique", str(tmp_path / "state"), "append").awaitTermination()
    assert spark.table("unique").count() == 30
