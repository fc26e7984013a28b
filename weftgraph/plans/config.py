"""Settings of an index, kept as JSON beside it."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields

from ..operators.text import Redaction

MODES = ("ast_only", "api_only", "both")
#: Settings of older files and what they are called now.
OLD_NAMES = {"include_patterns": "include", "exclude_patterns": "exclude", "mode": "summary_mode"}


@dataclass
class Config:
    include: list[str] = field(default_factory=list)  # empty: by the languages that are found
    exclude: list[str] = field(default_factory=list)
    summary_mode: str = "ast_only"
    staleness_threshold: int = 5
    redaction: Redaction = field(default_factory=Redaction)

    def set_mode(self, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.summary_mode = mode

    def add_exclude(self, pattern: str) -> None:
        if pattern not in self.exclude:
            self.exclude.append(pattern)

    def add_redaction_pattern(self, pattern: str) -> None:
        re.compile(pattern)
        if pattern not in self.redaction.custom:
            self.redaction.custom.append(pattern)

    def set_staleness_threshold(self, commits: int) -> None:
        if commits < 1:
            raise ValueError("the threshold is a positive number of commits")
        self.staleness_threshold = commits

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def loads(cls, text: str) -> Config:
        """Settings from JSON: old names are understood, unknown ones ignored."""
        data = {OLD_NAMES.get(k, k): v for k, v in json.loads(text or "{}").items()}
        known = {f.name for f in fields(cls)}
        made = cls(**{k: v for k, v in data.items() if k in known and k != "redaction"})
        own = {f.name for f in fields(Redaction)}
        made.redaction = Redaction(**{k: v for k, v in (data.get("redaction") or {}).items() if k in own})
        made.set_mode(made.summary_mode)
        return made
