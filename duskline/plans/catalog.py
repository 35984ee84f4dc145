"""Imports every plan module so that its queries register."""

from duskline.plans import associations, basics, fields, panels, resampling, screens, sources_checks  # noqa: F401
from duskline.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
