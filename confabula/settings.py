"""Typed settings, read from simple 'key: value' text; unknown keys and values of another type are errors.

Operators take their limits as arguments, of which DEFAULTS gives the default values; what parse() read is passed to them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The limits of the chat domain."""

    context_tokens: int = 128_000
    output_reserve_tokens: int = 4096
    least_prompt_tokens: int = 1024
    high_ratio: float = 0.8
    low_ratio: float = 0.5
    backfill_rows: int = 20
    max_steps: int = 5
    result_characters: int = 4000
    skills_a_turn: int = 2
    skill_refresh_seconds: int = 30
    hot_list_length: int = 50
    hot_list_hours: int = 24
    search_limit: int = 10
    memory_threshold: float = 0.6
    memory_limit: int = 10

    @classmethod
    def parse(cls, text: str) -> Settings:
        """Lines of 'key: value'; empty lines and those that begin with # don't count."""
        kinds, found = {f.name: f.type for f in fields(cls)}, {}
        for line in text.splitlines():
            if not line.strip() or line.strip().startswith("#"):
                continue
            key, colon, value = (x.strip() for x in line.partition(":"))
            if not colon or key not in kinds:
                raise ValueError(f"unknown setting: {line.strip()}")
            found[key] = (int if kinds[key] == "int" else float)(value)
        return cls(**found)

    @property
    def hot_list_ttl(self) -> str:
        return f"INTERVAL {self.hot_list_hours} HOURS"


DEFAULTS = Settings()
