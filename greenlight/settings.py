"""Thresholds and rule choices, turned into literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    page_minimum: int = 6
    page_limit: int = 12
    name_record_limit: int = 3
    record_name_limit: int = 5
    filename_words: int = 5
    similarity_limit: float = 35.0
    single_limit: float = 10.0
    active_rule: str = "final_id"
    zone: str = "America/Chicago"

    def __post_init__(self):
        if self.active_rule not in ("final_id", "upload_date"):
            raise ValueError(f"unknown active version rule: {self.active_rule}")
        for name in (
            "page_minimum",
            "page_limit",
            "name_record_limit",
            "record_name_limit",
            "filename_words",
        ):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
