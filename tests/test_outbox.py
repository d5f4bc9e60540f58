"""The outbox: each request once, in order, in numbers without gaps; a batch counts once its manifest is there."""
import pytest
from pyspark.sql import functions as F

from sitemill.plans import outbox as O


def _frames(spark):
    page = lambda s, k: (s, "POST", "/pages/", f'{{"n":{k}}}')
    cols = ", ".join(f"{c} string" for c in O.OUTBOX_COLUMNS)
    pages = [page("a", k % 300) for k in range(600)] + [page("b", 1), page("b", 1), (None, "POST", "/pages/", None)]
    logos = [("a", "PUT", f"/logos/{k}", "{}") for k in range(3)] * 2
    return {"pages": spark.createDataFrame(pages, cols), "logos": spark.createDataFrame(logos, cols), "files": spark.createDataFrame([("a", "POST", "/files/", "f")], cols)}


def test_each_request_once_and_in_order(spark):
    rows = O.outbox(_frames(spark)).collect()
    assert len(rows) == 300 + 1 + 1 + 3 + 1
    a = sorted((r for r in rows if r.site_id == "a"), key=lambda r: r.seq)
    assert [r.seq for r in a] == list(range(1, 305))
    assert [r.step for r in a] == [2] + [5] * 3 + [6] * 300
    assert [r.endpoint for r in a[1:4]] == ["/logos/0", "/logos/1", "/logos/2"]
    again = O.outbox({k: f.repartition(3, F.rand(1)) for k, f in _frames(spark).items()}).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_no_exchange_is_keyed_by_a_body(spark):
    plan = O.outbox(_frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(body" not in plan and "body#" in plan


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    path, out = str(tmp_path / "outbox"), O.outbox(_frames(spark))
    assert O.read_outbox(spark, path).count() == 0
    O.write_outbox(out, path, "one")
    want = sorted(map(str, out.collect()))
    O.write_outbox(out, path, "one")
    assert sorted(map(str, O.read_outbox(spark, path).collect())) == want
    manifest = spark.read.parquet(f"{path}/manifest/batch=one").orderBy("site_id").collect()
    assert [(r.site_id, r.requests, r.first, r.last) for r in manifest] == [(None, 1, 1, 1), ("a", 304, 1, 304), ("b", 1, 1, 1)]


def test_a_batch_without_manifest_does_not_count_and_is_replaced(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "outbox"), O.outbox(_frames(spark))
    O.write_outbox(out.where("site_id = 'b'"), path, "one")

    class Stopped(Exception):
        pass

    def stop(self, *args, **options):
        raise Stopped

    monkeypatch.setattr(type(out.groupBy()), "agg", stop)  # the attempt ends between the data and the manifest
    with pytest.raises(Stopped):
        O.write_outbox(out, path, "two")
    monkeypatch.undo()
    assert O.read_outbox(spark, path).count() == 1
    O.write_outbox(out.where("site_id = 'a'"), path, "two")
    assert O.read_outbox(spark, path).groupBy("site_id").count().orderBy("site_id").collect() == [("a", 304), ("b", 1)]
