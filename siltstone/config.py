"""Settings of an analysis: a frozen dataclass, read from YAML or JSON."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, fields, replace

# The defaults of an analysis.
DEFAULT_SEPARATORS = " \"'\\,;[]<>{}=()|:&?/+!@"


@dataclass(frozen=True)
class Config:
    data_dir: str = ""
    log_path: str = ""
    out_dir: str = ""
    log_format: str = ""
    timestamp_layout: str = ""
    msg_formats: tuple[str, ...] = ()
    search_regex: tuple[str, ...] = ()
    exclude_regex: tuple[str, ...] = ()
    separators: str = DEFAULT_SEPARATORS
    keywords: tuple[str, ...] = ()
    ignorewords: tuple[str, ...] = ()
    key_regexes: tuple[str, ...] = ()
    ignore_regexes: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    ignore_numbers: bool = False
    term_count_border: int = 0
    term_count_border_rate: float = 0.999
    min_match_rate: float = 0.7
    min_log_count: int = 0
    max_log_count: int = 0
    unit_secs: int = 86400
    keep_period: int = 30
    max_blocks: int = 0
    block_size: int = 0
    days_to_show: int = 0
    std_threshold: float = 2.0
    min_occurrences: float = 10.0
    pattern_detection_mode: str = "firstMatch"
    pattern_key_regexes: tuple[str, ...] = ()
    use_utc_time: bool = True

    def with_values(self, values: dict) -> Config:
        """A copy with the given fields, by their names here or in camel case; unset (None) ones stay.

        As in a YAML file, zero and empty values mean the default; unknown names raise ValueError.
        """
        known = {f.name: f for f in fields(self)}
        found = {}
        for name, value in values.items():
            own = re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)
            if own == "count_border":
                continue  # an old name that has no effect
            if own not in known:
                raise ValueError(f"unknown setting {name!r}")
            if value in (None, "", 0) and not isinstance(value, bool):
                continue
            found[own] = tuple([value] if isinstance(value, str) else value) if isinstance(known[own].default, tuple) else type(known[own].default)(value)
        return replace(self, **found)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls().with_values(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str, environment: dict[str, str] | None = None, **overrides) -> Config:
        """Settings of a YAML text; {{ NAME }} in string values (not in lists) is an environment variable."""
        import yaml

        values = substituted(yaml.safe_load(text) or {}, os.environ if environment is None else environment)
        return cls().with_values(values).with_values(overrides)


def substituted(value, environment):
    """value with {{ NAME }} replaced in strings and in nested maps; an unknown name is empty."""
    if isinstance(value, dict):
        return {k: substituted(v, environment) for k, v in value.items()}
    if isinstance(value, str):
        return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: environment.get(m[1], ""), value)
    return value
