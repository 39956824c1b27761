"""Seed rows of the hand-kept tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from leadcurve.constants import MEDAL_RULES, PAGE_SEED
from leadcurve.sources import schemas
from leadcurve.sources.local import local_table


def pages(spark: SparkSession) -> DataFrame:
    return local_table(spark, schemas.PAGES, PAGE_SEED)


def config(spark: SparkSession) -> DataFrame:
    rules = json.dumps(MEDAL_RULES, ensure_ascii=False)
    return local_table(spark, schemas.CONFIG, [("medalhas", rules)])


def aliases(spark: SparkSession, pairs) -> DataFrame:
    return local_table(spark, schemas.ALIASES, pairs)
