"""What the jobs share: configuration, session and log."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import SparkSession

LOG = "%(asctime)s %(name)s %(message)s"


def config(name: str, path: str | None = None) -> dict:
    """The settings of the JSON file beside the job, and those of another file over them."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        out = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            more = json.load(f)
        if unknown := set(more) - set(out):
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        out |= more
    return out


def session(name: str) -> SparkSession:
    """The command line's session, with the log on."""
    logging.basicConfig(level=logging.INFO, format=LOG)
    return SparkSession.builder.appName(name).getOrCreate()
