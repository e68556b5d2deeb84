import hashlib
import re

import pytest
from pyspark.sql import functions as F

from oscilla.llm import exact

LONG = "der eine and the others are at a loss. " * 2000
ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, " a b c"), (4, None), (2, ""), (8, LONG), (7, LONG.replace(" and ", " \n and ")), (6, LONG[:-1]), (10, "x" * 9000), (11, "x" * 9000), (12, "x" * 8999),
    (None, "a b c"), (None, "only null"), (3, "a b c"), (13, "a\x0bb\x0cc"), (14, "a\xa0b c"), (15, "a b c" + "\x1c"),
]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (doc, _), t in zip(rows, norm, strict=True):
        own = [d for (d, _), u in zip(rows, norm, strict=True) if u == t]
        ids = [d for d in own if d is not None]
        out.append((doc, min(ids) if ids else None, len(own), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_against_brute_force_however_weak_the_digest(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = exact.exact_groups(docs, digest=digest).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=str) == brute(ROWS)
    kept = [r for r in rows if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_chunks_give_the_text_again(spark):
    texts = [LONG, "", "x" * 10_000, "é" * 5000 + "\n", "a\r\n" * 3000, "😀" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        assert "".join(r["c"]) == r["t"]
        assert all(0 < len(c) <= exact.MOST for c in r["c"])
    # A change in front moves no cut far behind it.
    a, b = (spark.createDataFrame([(t,)], "t string").select(exact.chunks(F.col("t"))).first()[0] for t in (LONG[:20_000], "Hat an " + LONG[:20_000]))
    assert len(set(a) & set(b)) > 0


def test_filter_keeps_columns_and_one_row_of_each(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"row": F.lit("r"), "key": F.lit(1), "__x": F.lit(2)}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})


def test_empty_table_and_no_python(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(none).count() == 0
    plan = exact.exact_groups(none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_internal_name_may_be_a_column(spark):
    docs = spark.createDataFrame([(1, "a", 7, 8, 9), (2, "a", 7, 8, 9)], "doc_id long, text string, __row int, row int, _row int")
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a", 7, 8, 9)]
    assert exact.drop_exact(docs.limit(0)).columns == docs.columns


def test_rows_that_come_in_another_order_each_time(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text ', id % 50) as text").repartition(7, F.rand())
    kept = exact.drop_exact(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(50))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from oscilla.llm import common

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_tables_go_when_they_are_no_longer_needed(spark):
    from oscilla.llm import common

    before = common.written()
    paths = [common.durable(spark.range(3)).inputFiles()[0] for _ in range(3)]
    common.cleanup(since=before, keep=1)
    import os

    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, False, True]
    common.cleanup(since=before)
    assert common.written() == before


def test_one_cache_a_process():
    from oscilla.llm import common

    made = []
    for name in ("a", "a", "b", "b", "a"):
        assert common.kept(name, lambda: made.append(name) or [name]) == [name]
    assert made == ["a", "b", "a"] and len(common._KEPT) == 1
