"""What the jobs share: configs from small JSON files, checked by name and type, and their command line."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import Any, TypeVar, get_args, get_type_hints

from pyspark.sql import SparkSession

Config = TypeVar("Config")


def make_config(kind: type[Config], given: dict[str, Any]) -> Config:
    """A config from names and values; an unknown or missing name or a value of another type is an error that names it."""
    hints = get_type_hints(kind)
    if odd := sorted(set(given) - set(hints)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    needed = [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing := sorted(set(needed) - set(given)):
        raise ValueError(f"missing settings: {', '.join(missing)}")
    for name, value in given.items():
        allowed = tuple(t if isinstance(t, type) else list for t in get_args(hints[name]) or (hints[name],)) if not str(hints[name]).startswith("list") else (list,)
        if not isinstance(value, allowed) or (isinstance(value, bool) and bool not in allowed):
            raise ValueError(f"{name} can't be {value!r}")
    return kind(**given)


def command_line(kind: type[Config], job: Callable[[SparkSession, Config], Any], name: str, args: list[str] | None = None) -> int:
    """``--config FILE`` and ``--set name=value`` (JSON, or plain text) in a session that is made and stopped here."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    parser.add_argument("--config", help="a JSON file with the job's settings")
    parser.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE", help="settings that replace those of the file")
    given = parser.parse_args(args)
    values: dict[str, Any] = {}
    if given.config:
        with open(given.config, encoding="utf-8") as file:
            values = json.load(file)
    for item in given.set:
        key, _, text = item.partition("=")
        try:
            values[key] = json.loads(text)
        except json.JSONDecodeError:
            values[key] = text
    config = make_config(kind, values)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from pagequarry.session import build_session

    spark = build_session(name)
    try:
        job(spark, config)
    finally:
        spark.stop()
    return 0
