"""User patterns, written in Python's dialect, for Spark's Java engine."""

from __future__ import annotations

import re
import re._parser

from pyspark import SparkContext

from .patterns import U


def _group(name: str) -> str:
    """A group name of letters and digits, which is all that Java takes."""
    return "g" + name.encode().hex()


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Check a pattern and translate it; raises ``ValueError`` when invalid."""
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"bad pattern {pattern!r}: {exc}") from exc
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group(m[1])}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{_group(m[1])}>", named)
    java = ("(?iu)" if ignore_case else "") + U + named
    context = SparkContext._active_spark_context
    if context is not None:
        try:  # what Java refuses must fail here, not in a running job
            context._jvm.java.util.regex.Pattern.compile(java)
        except Exception as exc:  # noqa: BLE001 - whatever the JVM throws
            raise ValueError(f"pattern {pattern!r} can't be used: {exc}") from exc
    return java


def java_literal(text: str, ignore_case: bool = False) -> str:
    quoted = r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"
    return ("(?iu)" if ignore_case else "") + quoted


def java_replacement(text: str) -> str:
    """``\\1`` and ``\\g<name>`` become ``$1`` and ``${name}``."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\d+)>|\\(\d{1,2})", lambda m: f"${m[1] or m[2]}", out)
    return re.sub(r"\\g<(\w+)>", lambda m: f"${{{_group(m[1])}}}", out)


def check_replacement(pattern: str, text: str) -> None:
    """``ValueError`` if the replacement names a group that the pattern lacks."""
    try:
        re._parser.parse_template(text, re.compile(pattern))
    except (re.error, IndexError) as exc:
        raise ValueError(f"bad replacement {text!r}: {exc}") from exc


def plain_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", r"\$")
