"""Settings with their defaults; LOREKEEP_<NAME> in the environment overrides one (WATCH_SOURCES as JSON)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

# fixed values
CATEGORIES = ("preference", "decision", "fact", "gotcha")
SCOPES = ("user", "project", "shared")
CANDIDATE_SCOPES = ("user", "project")
STATUSES = ("proposed", "confirmed", "archived")
USER_KEY = "*"
KEYWORD_BONUS, KEYWORD_CAP = 0.1, 0.3
BRIEFING = {"facts": 10, "decisions": 5, "gotchas": 5, "conversations": 3}
CONTENT_CHARS = (10, 300)
ENTROPY_CHARS, ENTROPY_BITS = 28, 4.0
REINFORCE_STEP, REINFORCE_CAP = 0.1, 1.0
NOMINATIONS = 20
GIT_SECONDS = 5


@dataclass
class Settings:
    top_k: int = 5
    excerpt_chars: int = 6000
    recency_weight: float = 0.15
    recency_halflife_days: float = 7.0
    max_per_session: int = 5
    confidence_floor: float = 0.6
    reinforce_threshold: float = 0.85
    transcript_chars: int = 16000
    watch_interval: int = 30
    redact_first: bool = False
    scrub_forgotten: bool = False
    watch_sources: list = field(default_factory=list)

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        out = cls()
        for f in fields(cls):
            said = env.get(f"LOREKEEP_{f.name.upper()}")
            if said is None:
                continue
            now = getattr(out, f.name)
            value = json.loads(said) if isinstance(now, list) else said.lower() in ("1", "true", "yes") if isinstance(now, bool) else type(now)(said)
            setattr(out, f.name, value)
        return out
