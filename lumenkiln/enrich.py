"""Geocoders and captioners as pluggable frames-to-frames functions; the ones here answer from stored tables.

An `Enricher` takes the requests and gives a row for each that it can answer.  A service client would be another
implementation, called in batches on the executors; everything around it stays the same.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.address import provider_address
from .functions.text import coordinate_revision


class Enricher(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame: ...


class TableGeocoder:
    """Answers from stored provider payloads (coordinate_revision, payload): requests have latitude and longitude, answers the address as ``a``."""

    def __init__(self, stored: DataFrame):
        self._stored = stored.select("coordinate_revision", "payload")

    def __call__(self, requests: DataFrame) -> DataFrame:
        asked = requests.withColumn("coordinate_revision", coordinate_revision(F.col("latitude"), F.col("longitude")))
        return asked.join(self._stored, "coordinate_revision").withColumn("a", provider_address(F.col("payload"))).drop("payload")


class TableCaptioner:
    """Answers from stored captions (content_sha256, text); of several captions of a content the first by text counts."""

    def __init__(self, stored: DataFrame):
        self._stored = stored.groupBy("content_sha256").agg(F.min("text").alias("description_text"))

    def __call__(self, requests: DataFrame) -> DataFrame:
        return requests.join(self._stored, "content_sha256")


def geocoded(locations: DataFrame, geocoder: Enricher, provider: str, as_of: Column) -> DataFrame:
    """Locations with the answers of a geocoder; those without coordinates or an answer, and those resolved before, stay as they are."""
    wanted = locations.filter("latitude is not null and longitude is not null and provider is null").select("location_id", "latitude", "longitude")
    answers = geocoder(wanted).select("location_id", "a").dropDuplicates(["location_id"])
    rows = locations.join(answers, "location_id", "left")
    hit = F.col("a").isNotNull()
    put = {c: F.when(hit, F.col(f"a.{c}")).otherwise(F.col(c)) for c in ("street_address", "street_number", "city", "state", "country") if c in locations.columns}
    return rows.withColumns(put | {"provider": F.when(hit, F.lit(provider)).otherwise(F.col("provider")), "provider_updated": F.when(hit, as_of).otherwise(F.col("provider_updated"))}).select(*locations.columns)


def described(assets: DataFrame, descriptions: DataFrame, captioner: Enricher) -> DataFrame:
    """(asset_id, description_text) of photos without a current description that the captioner answers."""
    wanted = assets.filter("media_type = 'Photo'").join(descriptions.filter("is_current").select("asset_id"), "asset_id", "left_anti").select("asset_id", "content_sha256")
    return captioner(wanted).select("asset_id", "description_text")
