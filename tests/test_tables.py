"""Stored tables and PDF pages."""

from pyspark.sql import functions as F

from corvane.sources import pdf, tables


def test_tables_are_created_once(spark):
    for _ in range(2):
        tables.create_tables(spark, "corpus_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN corpus_test").collect()} >= set(tables.TABLES)
    spark.sql("INSERT INTO corpus_test.collections VALUES (1, 'a', current_timestamp())")
    assert spark.table("corpus_test.collections").count() == 1
    spark.sql("DROP DATABASE corpus_test CASCADE")


def test_swap_keeps_the_old_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    tables.swap_in(spark.range(3), folder)
    tables.swap_in(spark.read.parquet(folder).where("id > 0"), folder)
    assert spark.read.parquet(folder).count() == 2 and spark.read.parquet(folder + ".bak").count() == 3
    tables.swap_in(spark.range(1), folder)
    assert spark.read.parquet(folder + ".bak").count() == 2


def test_manifest_index_and_lines(spark, tmp_path):
    for k in range(2):
        tables.append_manifest(spark.createDataFrame([(str(k),)], "section string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    edges = spark.createDataFrame([("VEH", "1", 7)], "code string, section string, iid long")
    tables.write_index(edges, spark.createDataFrame([(2010, "x")], "year int, name string"), spark.createDataFrame([(1,)], "n long"), str(tmp_path / "i"))
    assert [(r.code, r.iid) for r in spark.read.json(str(tmp_path / "i" / "by_statute")).collect()] == [("VEH", 7)]
    tables.write_lines(spark.createDataFrame([("b",), ("a",), ("b",)], "s string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    ids = edges.withColumn("j", F.lit("CA")).select(tables.statute_id("j", "code", "section").alias("id")).first()
    assert ids.id == "ca/veh/1"


def test_pdf_pages_and_instructions(spark):
    def read(data):
        if data.endswith(b"broken"):
            raise ValueError("no trailer")
        return data[5:].decode().split("|")

    files = spark.createDataFrame([("a.pdf", b"%PDF-cover|one|" + b"two " * 20 + b"||four"), ("b.txt", b"hello"), ("c.pdf", b"%PDF-broken")], "path string, content binary")
    pages = pdf.pdf_pages(files, read).cache()
    got = {(r.path, r.page): (r.scanned, r.error) for r in pages.collect()}
    assert got["a.pdf", 3] == (False, None) and got["a.pdf", 1] == (True, None) and got["b.txt", None][1] == "not a PDF" and got["c.pdf", None][1] == "no trailer"
    (whole,) = pdf.whole_text(pages).collect()
    assert whole.text.startswith("[Page 1]\ncover\n\n[Page 2]\none") and "[Page 4]" not in whole.text
    outline = spark.createDataFrame([("a.pdf", 0, 1, "Series 100", True), ("a.pdf", 1, 1, "100. A", False), ("a.pdf", 2, 2, "101. B", False), ("a.pdf", 3, 4, "Series 200", True), ("a.pdf", 4, 4, "200. C", False)], "path string, at int, page int, title string, is_series boolean")
    found = {r.title: (r.series, r.page, r.end, r.text) for r in pdf.instruction_pages(outline, pages.where("page is not null")).collect()}
    assert found["100. A"] == ("Series 100", 1, 2, "cover") and found["101. B"][:3] == ("Series 100", 2, 4) and found["101. B"][3].startswith("one\ntwo") and found["200. C"] == ("Series 200", 4, 6, "\nfour")


def test_classifier_calls_are_tried_again(spark):
    from corvane.sources.providers import classified

    def classify(text):
        if text == "down":
            raise OSError("no answer")
        classify.calls = getattr(classify, "calls", 0) + 1
        if text == "shaky" and classify.calls % 2:
            raise OSError("once")
        return [text]

    rows = spark.createDataFrame([("a",), ("down",), (None,), ("shaky",)], "t string").repartition(1)
    got = {r.t: (r.c.tags, r.c.error) for r in rows.select("t", classified(F.col("t"), classify, pause=lambda s: None).alias("c")).collect()}
    assert got["a"] == (["a"], None) and got["down"] == (None, "no answer") and got[None] == (None, None) and got["shaky"][0] == ["shaky"]
