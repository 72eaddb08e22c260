"""The manifest's leaves are written as hashed and as ordered, not a third time with their ranks."""

from pyspark.sql import types as T

from gustflow.llm import merkle

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("text", T.StringType())])


def test_leaves_are_written_twice_at_most(spark, monkeypatch):
    sizes = []

    def recorded(df, name, write=merkle.written):
        out = write(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(merkle, "written", recorded)
    n = 700
    rows = [(i, "s", (None, "en", "en", "de")[i % 4], 3, f"A{i}") for i in range(n)]
    m = merkle.build(spark.createDataFrame(rows, SCHEMA))
    assert [name for name, k in sizes if k >= n] == ["merkle_leaves", "merkle_order"]
    got = sorted((r.tree, r.rank, r.size, r.doc_id) for r in m.leaves.collect())
    assert got == sorted((t, k, len(ids), d) for t, ids in
                         (("", range(0, n, 4)), (":en", [i for i in range(n) if i % 4 in (1, 2)]), (":de", range(3, n, 4)))
                         for k, d in enumerate(ids))
