"""The streaming daily-click aggregate equals the batch one."""

import datetime as dt  # noqa: F401
import os
import tempfile

from skupulse.operators import clicks as ck
from skupulse.sources.fixtures import clicks as bind_clicks
from skupulse.streaming.clicks import click_events_stream, daily_sku_clicks, run_to_table

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    ckpt = tempfile.mkdtemp(prefix="skupulse-stream-")
    run_to_table(daily_sku_clicks(click_events_stream(spark, SF, "events.parquet")), "daily_clicks_stream",
                 os.path.join(ckpt, "cp"))
    got = {(r.sku_ID, r.order_date, r.daily_clicks) for r in spark.sql("select * from daily_clicks_stream").collect()}
    want = {(r.sku_ID, r.order_date, r.daily_clicks) for r in ck.clicks_daily_sku(bind_clicks(spark, SF)).collect()}
    # every emitted (sku, day) equals the batch count, and every day that the
    # one-day watermark has closed (two days before the newest event) is emitted
    assert got and got <= want
    last = max(d for _, d, _ in want)
    closed = {x for x in want if (last - x[1]).days >= 2}
    assert closed <= got
