"""One repository with a third of all rows: results stay whole, and no group lands in one task."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from tokengrove.operators import order, tree
from tokengrove.plans import assemble as plan
from tokengrove.plans.assemble import assemble
from tokengrove.plans.lineage import shared_dir, work_dir
from tokengrove.plans.skew import mark, salted_join
from tokengrove.plans.slices import ranked, running


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(0, 6000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (n % 50).cast("string"))).alias("repo"),
        F.concat(F.lit("src/"), (n * 7919 % 6007).cast("string")).alias("rel_path"),
        (n % 17).alias("size"),
        F.when(n % 5 > 0, n % 11).alias("mtime_us"),
    ).cache()


def test_ranks_and_running_sums(rows):
    w = Window.partitionBy("repo").orderBy("rel_path")
    expected = rows.withColumn("rank", F.row_number().over(w)).withColumn(
        "before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("total", F.sum("size").over(Window.partitionBy("repo")))
    got = running(rows, ["repo"], [F.col("rel_path")], {"before": F.col("size")}, {"total": "before"})
    got = ranked(got, ["repo"], [F.col("rel_path")]).select(*expected.columns)
    assert got.exceptAll(expected).isEmpty() and got.count() == expected.count()


def test_a_hot_group_is_spread_over_slices(rows):
    placed = rows.repartitionByRange(8, "repo", "rel_path").withColumn("s", F.spark_partition_id())
    assert placed.where("repo = 'hot'").select("s").distinct().count() >= 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins(rows, how):
    dim = rows.select("repo").distinct().where("repo = 'hot' or repo > 'r3'").withColumn("v", F.length("repo"))
    right = dim if how in ("inner", "left") else dim.drop("v")
    plain = rows.join(right, "repo", how)
    got = salted_join(rows, right, ["repo"], how, ["rel_path"], salts=7).select(*plain.columns)
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()


def test_mark(rows):
    flagged = mark(rows, rows.where("repo = 'hot'"), ["repo"], "f", ["rel_path"])
    assert flagged.count() == 6000 and flagged.where("f").count() == 2000


def test_orders(rows):
    for method, key in (
        ("name-desc", [F.split("rel_path", "/").desc()]),
        ("date-asc", [F.col("mtime_us").asc_nulls_first(), F.split("rel_path", "/")]),
        ("date-desc", [F.col("mtime_us").desc_nulls_last(), F.split("rel_path", "/")]),
    ):
        expected = rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*key)))
        got = order.rank_files(rows, method).select(*expected.columns)
        assert got.exceptAll(expected).isEmpty() and got.count() == 6000
    assert order.sort_files(rows).first().repo == "hot"
    with pytest.raises(ValueError):
        order.sort_key("size")


def test_parts_are_bounded_and_whole(rows):
    pieces = rows.select("repo", F.array("rel_path").alias("key"), F.concat("rel_path", F.lit("\n")).alias("text"))
    got = assemble(pieces, ["repo"], ["key"], part_bytes=500).collect()
    assert max(len(r.text) for r in got) < 520
    texts = {}
    for r in sorted(got, key=lambda r: r.part):
        texts[r.repo] = texts.get(r.repo, "") + r.text
    for repo in ("hot", "r1"):
        paths = sorted(r.rel_path for r in rows.where(F.col("repo") == repo).collect())
        assert texts[repo] == "".join(p + "\n" for p in paths)
    lines = tree.tree_text(tree.full_tree(rows), part_bytes=700)
    assert lines.where("repo = 'hot'").count() > 5


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert work_dir(spark, "x") != work_dir(spark, "x")


@pytest.mark.parametrize("flush", [(1, 10), (9, 3), (1 << 20, 1000)])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_runs_of_pieces_in_any_batches(monkeypatch, flush, kind):
    """Parts come out whole wherever batches begin, empty batches and empty pieces included."""
    monkeypatch.setattr(plan, "FLUSH_BYTES", flush[0])
    monkeypatch.setattr(plan, "FLUSH_ROWS", flush[1])
    schema = pa.schema([("repo", pa.string()), ("part", pa.int64()), ("parts", pa.int64()), ("text", kind)])
    for seed in range(40):
        pick = random.Random(seed)
        rows = [
            {"repo": repo, "part": part, "parts": 4, "text": pick.choice(["", "fig", "pâté\n", "\U0001f330 "]) * pick.randint(0, 3)}
            for repo in (None, "a", "b")
            for part in range(pick.randint(0, 4))
            for _ in range(pick.randint(1, 4))
        ]
        batches, at = [], 0
        while at < len(rows):
            n = pick.randint(0, 5)
            batches.append(pa.RecordBatch.from_pylist(rows[at : at + n], schema=schema))
            at += n
        want = {}
        for row in rows:
            key = row["repo"], row["part"]
            want[key] = want.get(key, "") + row["text"]
        got = [r for b in plan._concatenated(iter(batches), 2) for r in b.to_pylist()]
        assert got == [{"repo": k[0], "part": k[1], "parts": 4, "text": v} for k, v in want.items()]
