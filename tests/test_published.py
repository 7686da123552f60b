"""Publication as a switch, pruned reads, stale versions."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.lines import LineFilter, matching
from ledgerlens.plans.line_queries import flagged
from ledgerlens.sources import published

DATA = "/root/testdata/sf0.001"
FILTERS = [
    LineFilter(), LineFilter(datasets=("act_2570_draft",)), LineFilter(years=(2538, 2540)), LineFilter(year_from=2543), LineFilter(item_keys=("red plate", "hot ring")),
    LineFilter(datasets=("pbo_disbursement",), year_to=2539, item_keys=("redplate", "no such key")), LineFilter(provinces=("NATION_4",), keyword="RED", exclude_flags=()), LineFilter(years=(1999,)),
]


@pytest.fixture(scope="module")
def lines(spark):
    return flagged(spark, DATA).cache()


@pytest.fixture
def root(spark, lines, tmp_path):
    published.publish(lines, f"{tmp_path}/p")
    return f"{tmp_path}/p"


def ids(frame):
    return sorted(r["source_id"] for r in frame.select("source_id").collect())


def test_pruned_reads_give_what_the_whole_table_gives(spark, lines, root):
    reader = published.Published(spark, root)
    assert reader.release.n_rows == lines.count() and reader.release.n_shards == reader.facts().select("path").distinct().count()
    for wanted in FILTERS:
        assert ids(reader.matching(wanted)) == ids(matching(lines, wanted)), wanted
    some = [r[0] for r in lines.select("source_id").orderBy("source_id").limit(3).collect()]
    assert ids(reader.by_ids([*some, "none"])) == some


def test_lines_without_a_year_are_never_asked_for_by_year(spark, lines, tmp_path):
    bare = lines.withColumn("fiscal_year_be", F.when(F.col("dataset") != "act_2570_draft", F.col("fiscal_year_be")))
    published.publish(bare, f"{tmp_path}/b")
    reader = published.Published(spark, f"{tmp_path}/b")
    for wanted in (LineFilter(years=(2540,)), LineFilter(year_from=2540), LineFilter()):
        assert ids(reader.matching(wanted)) == ids(matching(bare, wanted))


def test_partitions_and_row_groups_are_pruned(spark, root):
    reader = published.Published(spark, root)
    plan = reader.matching(LineFilter(datasets=("act_2570_draft",), item_keys=("red plate",)))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [dataset" in plan and "In(item_key" in plan or "EqualTo(item_key" in plan
    names = [os.path.join(folder, n) for folder, _, files in os.walk(root) for n in files if n.endswith(".parquet") and "/facts/" in folder]
    import pyarrow.parquet as pq

    for name in names[:20]:
        keys = [k for k in pq.read_table(name, columns=["item_key"])["item_key"].to_pylist() if k is not None]
        assert keys == sorted(keys)
    assert reader.by_ids(["0" * 16])._jdf.queryExecution().toString().count("source_id,0000000000000000)")


def test_a_write_that_stops_leaves_the_version_before(spark, lines, root, monkeypatch):
    reader = published.Published(spark, root)
    fewer = lines.filter("dataset = 'act_2570_draft'")

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(published, "_release", stop)
        with pytest.raises(RuntimeError, match="killed"):
            published.publish(fewer, root)
    assert published.current(spark, root) == reader.release and reader.up_to_date() is reader
    assert published.Published(spark, root).facts().count() == lines.count()
    assert len(os.listdir(f"{root}/versions")) == 2
    # the next one counts, and what was left goes
    made = published.publish(fewer, root)
    later = reader.up_to_date()
    assert later.release == made and later.facts().count() == fewer.count() and reader.facts().count() == lines.count()
    assert published.drop_stale(spark, root, keep=2) and sorted(os.listdir(f"{root}/versions")) == sorted([reader.release.version, made.version])
    assert published.drop_stale(spark, root) == [reader.release.version] and published.drop_stale(spark, root) == []
    assert later.facts().count() == fewer.count()


def test_two_writers_of_one_number(spark, lines, root):
    with pytest.raises(Exception, match="(?i)exists"):
        published._release(spark, root, published.current(spark, root))


def test_nothing_published(spark, tmp_path):
    assert published.current(spark, f"{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        published.Published(spark, f"{tmp_path}/none")
