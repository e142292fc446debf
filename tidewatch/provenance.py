"""Digests, the frozen protocol, and the run log."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import subprocess
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.feeds import parse_config


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def check_digest(text: str | None, pinned: str | None) -> str:
    """ok, changed, missing (nothing to check) or unpinned; it never raises: the caller says it and goes on."""
    if text is None:
        return "missing"
    if not pinned:
        return "unpinned"
    return "ok" if text_digest(text).startswith(pinned) else "changed"


def load_protocol(text: str, pinned: str | None = None) -> dict:
    """The protocol's sections, with its digest and whether that is the pinned one."""
    return {"sections": parse_config(text), "sha256": text_digest(text), "frozen": check_digest(text, pinned)}


def git_commit() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def tool_version(command: list[str]) -> str | None:
    """The first non-blank line that a tool prints, or null; never an error."""
    try:
        got = subprocess.run(command, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return next((x.strip() for x in (got.stdout + got.stderr).splitlines() if x.strip()), None)


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Run:
    """One run's record: fields that may be set, items that may be added."""

    def __init__(self, kind: str, tools: dict[str, list[str]] | None = None):
        self.fields = {"kind": kind, "status": "running", "started": now(), "git_commit": git_commit(), "tools": {k: tool_version(v) or "" for k, v in (tools or {}).items()}, "items": []}

    def add(self, **item) -> None:
        self.fields["items"].append({k: str(v) for k, v in item.items()})

    def set(self, **fields) -> None:
        self.fields |= fields


@contextlib.contextmanager
def recorded(path: str, kind: str, tools: dict[str, list[str]] | None = None):
    """A run whose record is appended to a log also when it fails; a log that can't be written is only warned of."""
    run = Run(kind, tools)
    try:
        yield run
        run.set(status="ok" if run.fields["status"] == "running" else run.fields["status"])
    except BaseException as e:
        run.set(status="error", error="".join(traceback.format_exception_only(e)).strip())
        raise
    finally:
        run.set(finished=now())
        try:
            with open(path, "a", encoding="utf-8") as f:
                f.write(json.dumps(run.fields, sort_keys=True) + "\n")
        except OSError as e:
            print(f"the run log can't be written: {e}", file=sys.stderr)
