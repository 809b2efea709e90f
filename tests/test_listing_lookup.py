"""Pages from a listing on disk (SRT-02) and lookups that skip row groups (PRJ-05)."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from shelfwise.operators import catalog as C
from shelfwise.operators.accounts import lookup
from shelfwise.sources.keyed_files import listed, lookup_listed, write_for_lookup
from shelfwise.sources.listing import Listing


def _leaf(plan):
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan


def _catalog(spark, rows, seed=5):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice([None, 1.0, 2.5, 2.5, 4.9, round(rng.uniform(1, 5), 1)]), f"n{i % 7}") for i in rng.sample(range(rows * 3), rows)],
                                 "function_id bigint, average double, name string")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size, ranges", [(40, 5), (7, 64)])
def test_pages_walk_through_the_whole_listing(spark, tmp_path, descending, size, ranges):
    rows = _catalog(spark, 400)
    listing = Listing.build(rows, str(tmp_path / "l"), "average", "function_id", descending, ranges)
    assert sorted(map(tuple, listing.read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sign = -1 if descending else 1
    want = sorted(map(tuple, rows.collect()), key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
    got, after = [], None
    while len(got) < len(want) or not got:
        part = [tuple(r) for r in listing.page(size, after).collect()]
        assert part and part == want[len(got):len(got) + size]
        got += part
        after = (part[-1][1], part[-1][0])
        if len(got) > 5 * size:            # then jump near the end, among the rows without a value
            got = want[:len(want) - 2 * size] if len(got) < len(want) - 2 * size else got
            after = (got[-1][1], got[-1][0])
    assert listing.page(size, after).count() == 0


def test_a_page_opens_two_ranges(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS function_id", "CAST(id % 3 AS double) AS average")
    listing = Listing.build(rows, str(tmp_path / "l"), "average", "function_id", ranges=10)
    assert listing.bounds().count() == 10 and listing.bounds().agg({"n": "sum"}).first()[0] == 1000
    for after in (None, (0.0, 297), (1.0, 100), (2.0, 500)):
        assert len(listing.ranges_of(50, after)) <= 2
        p = listing.page(50, after)
        assert [tuple(r) for r in p.collect()] == [tuple(r) for r in C.page(rows, "average", "function_id", 50, after).collect()]
        scan = _leaf(p._jdf.queryExecution().executedPlan())
        assert 1 <= scan.metrics().apply("numFiles").value() <= 2
    assert listing.ranges_of(50, (2.0, 10**6)) == []


def test_listings_of_nothing_of_ties_and_of_clashing_names(spark, tmp_path):
    none = spark.createDataFrame([], "function_id bigint, average double")
    assert Listing.build(none, str(tmp_path / "e"), "average", "function_id").page(5).count() == 0
    same = spark.range(300).selectExpr("id AS function_id", "CAST(NULL AS double) AS average")
    listing = Listing.build(same, str(tmp_path / "s"), "average", "function_id", ranges=6)
    assert [r[0] for r in listing.page(20, (None, 149)).collect()] == list(range(150, 170))
    with pytest.raises(ValueError):
        Listing.build(same.withColumnRenamed("average", "range_no"), str(tmp_path / "c"), "range_no", "function_id")


def test_a_key_list_skips_row_groups(spark, tmp_path):
    # Names in no order of the table's number, so a list spreads over all row groups.
    table = spark.range(200_000).selectExpr("sha2(CAST(id AS string), 256) AS name", "id AS user_id", "repeat(sha2(CAST(-id AS string), 256), 2) AS note")
    path = str(tmp_path / "t")
    write_for_lookup(table, path, "name", files=4, group_bytes=1 << 20)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/part-*")]
    assert sum(groups) >= 16
    wanted = table.where("user_id IN (3, 77777, 150001)").select("name").unionByName(spark.createDataFrame([("no such name",), (None,), ("f" * 64,)], "name string"))
    stored = spark.read.parquet(path)
    few = listed(stored, wanted, "name")
    assert sorted(r["user_id"] for r in few.collect()) == [3, 77777, 150001]
    plan = few._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(name" in plan.toString()
    few._jdf.collectToPython()             # the same plan, run for its figures
    read = _leaf(plan).metrics().apply("numOutputRows").value()
    assert 0 < read <= 2 * 4 * 200_000 / sum(groups), (read, groups)
    got = {r["name"]: (r["user_id"], r["found"]) for r in lookup_listed(stored, wanted, "name").collect()}
    assert got == {r["name"]: (r["user_id"], r["found"]) for r in lookup(stored, wanted, "name").collect()}
    assert sum(f for _, f in got.values()) == 3 and len(got) == 6
    # A list beyond the bound is joined, with the same rows.
    assert listed(stored, wanted, "name", most=2) is stored
    assert {r["name"]: (r["user_id"], r["found"]) for r in lookup_listed(stored, wanted, "name", most=2).collect()} == got
    assert lookup_listed(stored, wanted.limit(0), "name").count() == 0
