from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("text_q", "logs_q", "docs_q", "summary_q", "tabular_q", "config_q", "corpus_q",
           "code_q", "flow_q", "media_q", "render_q", "files_q")


def query(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"quire.plans.{m}")
