"""An engine from settings given as text, as configuration files have them. What is missing, blank or unreadable has its default."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..functions.grammar import PATTERNS
from ..operators.guess import GuessParams
from ..operators.image import ImageParams
from ..operators.passes import ROTATE_BELOW
from ..sources.readers import read_master
from .pipeline import Engine


def text(settings: Mapping[str, str | None], name: str) -> str | None:
    return (settings.get(f"Ocr:{name}") or "").strip() or None


def number(settings: Mapping[str, str | None], name: str, default: Any) -> Any:
    """Of the default's type: whole numbers of 32 bits, or those with a point."""
    value = text(settings, name) or ""
    try:
        found = type(default)(value)
    except ValueError:
        return default
    return default if "_" in value or isinstance(found, int) and not -(2**31) <= found < 2**31 else found


def configured(spark: SparkSession, settings: Mapping[str, str | None]) -> tuple[Engine, ImageParams]:
    """Patterns are parted by semicolons. Unless the settings ask for it, a verified code need not be in the list."""
    # The settings' names.
    params = GuessParams(
        decay=number(settings, "Lambda", GuessParams.decay), verified_probability=number(settings, "VerifiedThreshold", GuessParams.verified_probability),
        verified_margin=number(settings, "VerifiedMargin", GuessParams.verified_margin), require_master=(text(settings, "RequireMasterListForVerification") or "").lower() == "true",
    )
    given = text(settings, "ArticlePatterns")
    patterns = tuple(p for p in map(str.strip, given.split(";")) if p) if given else PATTERNS
    sizes = ImageParams(longest=number(settings, "MaxImageDimension", ImageParams.longest), shortest=number(settings, "MinImageDimension", ImageParams.shortest))
    return Engine(read_master(spark, text(settings, "MasterListPath")), patterns, params, rotate_below=number(settings, "RotationFallbackConfidence", ROTATE_BELOW)), sizes
