from pyspark.sql import functions as F

from corvane.operators import lookups, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hits_and_rows(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "a"), ("q", 4, "c"), ("r", 1, "none"), ("r", 2, None)], "q string, at int, url string")
    held = spark.createDataFrame([("a", 10, "A"), ("b", 11, None), ("c", 12, "C")], "url string, id long, name string")
    assert rows(lookups.hits_by(hits, held, ["url"], ["q"], "at", "id", 2)) == [("q", 10, 1), ("q", 11, 2)]
    assert rows(lookups.with_rows(hits, held, ["url"], {"name": F.lit("-")})) == [("q", 1, "a", "A"), ("q", 2, "b", "-"), ("q", 3, "a", "A"), ("q", 4, "c", "C"), ("r", 1, "none", "-"), ("r", 2, None, "-")]


def test_first_children(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    children = spark.createDataFrame([(1, 5, "b"), (1, 2, "z"), (1, 2, "a"), (2, None, "n"), (2, 1, "m")], "k long, i int, t string")
    got = {r.k: (r.i, r.t) for r in lookups.first_child(parents, children.where("i IS NOT NULL"), "k", "i", ["t"]).collect()}
    assert got == {1: (2, "a"), 2: (1, "m")}


def test_citing_items(spark):
    edges = spark.createDataFrame([("CA/VEH/1", "x"), ("CA/VEH/1/a", "x"), ("CA/VEH/1/a", "y"), ("CA/VEH/1/b", "z")], "key string, iid string")
    asked = spark.createDataFrame([("CA/VEH/1/a",), ("CA/VEH/1",), ("CA/VEH/9",)], "asked string")
    assert rows(lookups.citing_items(asked, edges, "asked", "key", "iid")) == [("CA/VEH/1", "x", 0), ("CA/VEH/1/a", "x", 0), ("CA/VEH/1/a", "y", 1)]


def test_cited_rows_and_roles(spark):
    edges = spark.createDataFrame([("i", "CA/VEH/1", "sources", 3), ("i", "CA/VEH/1", "title", 9), ("i", "CA/VEH/2", "sources", 1), ("i", "CA/VEH/0", "odd", 1), ("j", "CA/VEH/2", None, 1)], "iid string, key string, role string, at int")
    got = {r.iid: [(c.key, c.role) for c in r.cited] for r in lookups.citations_by_role(edges, "iid", "key", F.col("role"), "at", ["title", "sources", "directions"]).collect()}
    assert got == {"i": [("CA/VEH/1", "title"), ("CA/VEH/2", "sources"), ("CA/VEH/0", "directions")], "j": [("CA/VEH/2", "directions")]}
    statutes = spark.createDataFrame([("CA", "VEH", "1", "one"), ("CA", "VEH", "7", "seven")], "j string, c string, s string, title string")
    assert rows(lookups.cited_rows(edges.select("iid", "key"), statutes, "key", [F.col("j"), F.col("c"), F.col("s")], ["title"])) == [("CA/VEH/1", "i", "one")]


def test_project_edits(spark):
    projects = spark.createDataFrame([(1, "one", [5]), (2, "two", []), (3, "three", [1])], "id long, name string, items array<long>")
    edits = [
        (1, 2, "add", None, 7), (1, 1, "add", None, 5), (1, 3, "remove", None, 5), (1, 4, "rename", "uno", None), (1, 5, "create", "other", None), (2, 1, "delete", None, None), (2, 2, "add", None, 1), (2, 3, "create", "again", None), (2, 4, "add", None, 9),
        (4, 1, "create", "four", None), (4, 2, "add", None, 2), (4, 3, "add", None, 2), (5, 1, "rename", "no", None), (6, 1, "create", "x", None), (6, 2, "delete", None, None),
    ]
    table = spark.createDataFrame(edits, "id long, at int, kind string, name string, item long")
    assert rows(lookups.edit_projects(projects, table)) == [(1, "uno", [7]), (2, "again", [9]), (3, "three", [1]), (4, "four", [2])]
    assert rows(lookups.edit_projects(projects, table.limit(0))) == [(1, "one", [5]), (2, "two", []), (3, "three", [1])]


def test_counts(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("b", 2, False)], "k string, s int, h boolean")
    assert rows(reports.counts_by(df, ["k"], {"yes": F.col("h"), "no": ~F.col("h")}, "n")) == [("a", 2, 1, 0), ("b", 1, 0, 1)]
    assert rows(reports.coverage(df, F.col("h"), F.col("s"))) == [(3, 1, 2, 1)] and rows(reports.graph_counts(df, {"keys": "k"})) == [(2, 3)]
    assert rows(reports.consolidation_totals(df, F.col("k"), F.col("h"))) == [(2, 2, 1)]
