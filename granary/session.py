"""Session builder and configuration, with the defaults that the operators' semantics rest on."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Retrieval:
    k_dense: int = 40
    k_lexical: int = 20
    k_final: int = 10
    per_section: int = 2
    boosts: dict = field(default_factory=lambda: {"title": 1.4, "breadcrumbs": 1.2, "param_name": 2.0, "error_code": 2.5})
    k1: float = 0.9
    b: float = 0.55
    dense_weight: float = 0.6
    lexical_weight: float = 0.4
    model_weight: float = 0.7


@dataclass(frozen=True)
class Answers:
    most_chunks: int = 6
    most_tokens: int = 8000
    sufficient: float = 0.5
    least_score: float = 0.4
    widest_gap: float = 0.35
    suggestion: float = 0.1
    least_chars: int = 50


@dataclass(frozen=True)
class Ingest:
    least_section_chars: int = 100
    most_html_chars: int = 500_000
    image_least_side: int = 100
    image_most_bytes: int = 10 * 1024 * 1024
    extensions: tuple[str, ...] = ("html", "htm", "pdf")


@dataclass(frozen=True)
class Chunking:
    parent_tokens: int = 800
    overlap_tokens: int = 100
    procedure_tokens: int = 350
    procedure_overlap: int = 50
    parameter_tokens: int = 200
    table_rows: int = 25


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = Retrieval()
    answers: Answers = Answers()
    ingest: Ingest = Ingest()
    chunking: Chunking = Chunking()


def session(name: str = "granary", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the submitted configuration wins over these values."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
