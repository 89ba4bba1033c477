"""Settings as a frozen dataclass, and the warnings that a combination of them earns (SRC14, MON2)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    batch_size: int = 10
    max_concurrent: int = 5
    scrape_delay: float = 2.0
    requests_per_minute: int = 15
    requests_per_day: int = 1500
    tokens_per_day: int = 1_000_000
    rate_limit_per_minute: int = 60
    similarity_threshold: float = 0.8
    pii_min_confidence: float = 0.5
    retention_days: int = 30
    debug: bool = False
    sanitize: bool = True
    alert_webhook: str = ""

    @staticmethod
    def from_env(prefix: str = "TARNQUERY_", env: dict[str, str] | None = None) -> Settings:
        """Values of environment variables named like the fields in capitals; others keep their defaults."""
        env = os.environ if env is None else env
        out = {}
        for f in fields(Settings):
            raw = env.get(f"{prefix}{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                out[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return Settings(**out)

    def problems(self) -> list[str]:
        """What makes the settings unusable."""
        out = [f"{n} must be above 0" for n in ("batch_size", "max_concurrent", "requests_per_minute", "requests_per_day", "retention_days") if getattr(self, n) <= 0]
        out += [f"{n} must be between 0 and 1" for n in ("similarity_threshold", "pii_min_confidence") if not 0 <= getattr(self, n) <= 1]
        return out + (["requests_per_minute exceeds requests_per_day"] if self.requests_per_minute > self.requests_per_day else [])

    def warnings(self) -> list[str]:
        """What works but isn't safe."""
        said = ((self.debug, "debug is on"), (not self.sanitize, "personal data isn't sanitized"), (self.scrape_delay < 1, "the delay between requests is short"), (self.alert_webhook and not self.alert_webhook.startswith("https://"), "the webhook isn't encrypted"))
        return [text for bad, text in said if bad]
