"""Candidate extraction and scoring queries over F2 replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replies as R
from ..operators import scoring as S
from . import replies_fixture as F2


def _replies(spark, sf):
    return F2.replies(spark, sf)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    _, c = R.extract(_replies(spark, sf), "conv_id")
    return c


def candidates_strict(spark: SparkSession, sf: str) -> DataFrame:
    return R.extract_strict(_replies(spark, sf), "conv_id")


def _scored(spark, sf):
    rep = _replies(spark, sf)
    meta, c = R.extract(rep, "conv_id")
    c = c.join(rep.select("conv_id", "score_reply"), "conv_id")
    return meta, S.score(c, model_reply="score_reply")


def patch_scores(spark: SparkSession, sf: str) -> DataFrame:
    _, s = _scored(spark, sf)
    return s.select("conv_id", "patch_id", "patch_size", "syntax", "style", "exception", "docstring",
                    "variable", "pattern", "llm", "total")


def best_patch(spark: SparkSession, sf: str) -> DataFrame:
    meta, s = _scored(spark, sf)
    return S.bundle(meta, s, "conv_id").select("conv_id", "file_name", "function_name", "best_patch_id",
                                              "best_total", "best_func")


def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    meta, s = _scored(spark, sf)
    return S.bundle(meta, s, "conv_id").select("conv_id", "n_blocks", "n_scored", "quarantine")
