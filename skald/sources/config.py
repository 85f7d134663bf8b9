"""Settings of a crawl and its processing, as plain values with defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Wikipedia:
    root_category: str = ""
    max_depth: int = 8
    min_words: int = 1000
    revisit_days: int = 7
    max_pages: int = 0


@dataclass(frozen=True)
class Encyclopedia:
    enabled: bool = True
    sitemap: str = ""
    allowed_prefixes: tuple[str, ...] = ()
    min_words: int = 500
    revisit_days: int = 14
    max_pages: int = 0


@dataclass(frozen=True)
class Settings:
    store: str = "store"
    wikipedia: Wikipedia = field(default_factory=Wikipedia)
    encyclopedia: Encyclopedia = field(default_factory=Encyclopedia)

    @staticmethod
    def load(path: str) -> Settings:
        """Settings from a JSON file, or a YAML one where a YAML reader is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            return Settings.of(json.loads(text))
        except json.JSONDecodeError:
            import yaml

            return Settings.of(yaml.safe_load(text) or {})

    @staticmethod
    def of(values: Mapping) -> Settings:
        """Settings from a nested mapping; unknown names are ignored."""

        def take(kind, given: Mapping):
            return kind(**{f.name: tuple(v) if isinstance(v := given[f.name], list) else v for f in fields(kind) if f.name in given})

        return Settings(values.get("store", "store"), take(Wikipedia, values.get("wikipedia") or {}), take(Encyclopedia, values.get("encyclopedia") or {}))
