"""Worked examples of the scalar library."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lumenkiln.functions import address, geo, text, times, usage


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cost(spark):
    row = one(spark, *[usage.cost_usd(F.lit(i), F.lit(c), F.lit(o)).alias(n) for n, i, c, o in (("a", 1000, 400, 100), ("b", 10, 11, 5), ("c", 800, 0, 12), ("d", 2561, 0, 1))])
    assert (row.a, row.b, row.c, row.d) == (Decimal("0.002480"), None, Decimal("0.001744"), None)
    assert usage.max_request_cost() == Decimal("0.006320")


def test_usage_counts(spark):
    body = F.lit('{"usage": {"input_tokens": 7, "output_tokens": true, "total_tokens": "9x"}, "input_tokens": 3}')
    row = one(spark, usage.usage_count(body, "$.usage.input_tokens", "$.input_tokens").alias("a"), usage.usage_count(body, "$.usage.output_tokens").alias("b"), usage.usage_count(body, "$.usage.total_tokens").alias("c"))
    assert tuple(row) == (7, None, None)


def test_token_groups():
    assert address.token_groups("221 Example Ave, Sampleton") == [["221"], ["example"], ["ave", "avenue"]]
    assert address.token_groups("") == []
    assert address.token_groups("One Two Three Four") == [["one"], ["two"], ["three"]]


def test_cutoff_follows_daylight_saving(spark):
    at = lambda s: times.utc_from_local("America/New_York", F.lit(s).cast("timestamp_ntz"))
    row = one(spark, at("2024-01-15 00:00:00").alias("winter"), at("2024-07-15 00:00:00").alias("summer"))
    assert row.winter == dt.datetime(2024, 1, 15, 5) and row.summer == dt.datetime(2024, 7, 15, 4)


@pytest.mark.parametrize(("value", "minutes"), [("+05:30", 330), ("-0400", -240), ("+14:00", 840), ("+14:01", None), ("+15:00", None), ("5:30", None), ("-03:60", None)])
def test_offsets(spark, value, minutes):
    assert one(spark, times.parse_offset(F.lit(value)).alias("m")).m == minutes


def test_offset_label(spark):
    row = one(spark, *[times.offset_label(F.lit(m)).alias(f"m{i}") for i, m in enumerate((-210, 0, 345))])
    assert tuple(row) == ("UTC-03:30", "UTC+00:00", "UTC+05:45")


def test_cursor():
    position = ["2026-01-02T03:04:05", 7]
    assert text.decode_cursor(text.encode_cursor("media", position), "media") == position
    assert text.decode_cursor(None, "media") is None
    for bad in ("%%%", text.encode_cursor("jobs", position), text.encode_cursor("media", position)[:-4]):
        with pytest.raises(ValueError):
            text.decode_cursor(bad, "media")


def test_captions(spark):
    row = one(
        spark, text.clip_caption(F.lit("  A dog\n runs. It barks. "), 10).alias("a"), text.clip_caption(F.lit("one two three four"), 2).alias("b"), text.clip_caption(F.lit("   "), 5).alias("c"),
        text.normal_description(F.lit("Two. Sentences"), 9).alias("d"), text.normal_description(F.lit("a b c d."), 2).alias("e"), text.normal_description(F.lit(" "), 2).alias("f"),
    )
    assert tuple(row) == ("A dog runs.", "one two.", "", None, "a b.", None)


def test_rules(spark):
    rules = [address.Rule("first", "One", city="Alpha"), address.Rule("second", "Two"), address.Rule("third", "Three")]
    columns = {k: F.lit(v) for k, v in (("city", "alpha"), ("state", "S"), ("country", "C"), ("street", "x"), ("number", None))}
    row = one(spark, address.first_rule(rules, "v2", **columns).alias("a"), address.first_rule(rules[1:], "v2", **columns).alias("b"))
    assert row.a.asDict() == {"name": "first", "street": "One", "version": "first@v2"} and row.b.name == "second"


def test_provider_fallbacks(spark):
    row = one(spark, address.provider_address(F.lit('{"Position": [4.5, 50.25], "Address": {"SubDistrict": "North", "Region": {"Code": "R1"}}}')).alias("a")).a
    assert (row.display_name, row.state, row.neighborhood, row.street_address) == ("R1", "R1", "North", None)
    assert one(spark, address.provider_address(F.lit('{"Position": [4.5, 50.25]}')).alias("a")).a.display_name == "50.25, 4.5"


def test_geo(spark):
    row = one(
        spark, geo.haversine(F.lit(40.6687), F.lit(-74.1143), F.lit(40.66873), F.lit(-74.1143)).alias("near"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("far"),
        geo.iso6709(F.lit("+40.5-074.25+010/"))[1].alias("lon"), geo.iso6709(F.lit("nowhere"))[0].alias("none"),
    )
    assert 3.3 < row.near < 3.4 and abs(row.far - 20015114) < 100 and row.lon == -74.25 and row.none is None


def test_response_text(spark):
    row = one(spark, usage.response_text(F.lit('{"output_text": " ", "output": [{"content": [{"text": ""}, {"text": " said "}]}]}')).alias("a"), usage.response_text(F.lit("{}")).alias("b"))
    assert tuple(row) == ("said", None)
