"""What the jobs share: config files, settings for a while, existing output, logging."""

from __future__ import annotations

import contextlib
import json
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """``defaults`` with what the JSON file at ``path`` says; it may lie in any store. Unknown keys are errors."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


@contextlib.contextmanager
def settings(spark: SparkSession, **given):
    """Settings (dots as double underscores) inside of the block; afterwards they are as before. None leaves a setting as it is."""
    names = {k.replace("__", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        if v is not None:
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one where no run has written it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(description: str, arguments: list[tuple[str, str]], main) -> None:
    """Parse plain path arguments and ``--config``, and run ``main(spark, args, config)`` in a session of its own."""
    import argparse

    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(description=description)
    for name, text in arguments:
        parser.add_argument(name, help=text)
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(parser.prog).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        main(spark, args)
    finally:
        spark.stop()
