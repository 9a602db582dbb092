"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import array_queries, box_queries, file_queries, join_queries, pixel_queries, plan_queries, work_queries
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "array_queries", "box_queries", "file_queries", "flagship", "pixel_queries", "plan_queries", "work_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy-move candidates of every box."""
    return join_queries.j3(spark, sf_dir)
