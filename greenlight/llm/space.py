"""Disk space of finished steps."""

from greenlight.session import release

__all__ = ["release"]
