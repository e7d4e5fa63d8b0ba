"""Registry of versioned artifacts: immutable configurations that must agree."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass
class Registry:
    """Versions by kind. A version is registered once; the same configuration again is a reuse."""

    entries: dict[tuple[str, str], dict] = field(default_factory=dict)

    def register(self, kind: str, version: str, config: dict) -> bool:
        """True if new, False if reused; another configuration under a known version is refused."""
        known = self.entries.get((kind, version))
        if known is None:
            self.entries[kind, version] = dict(config)
            return True
        if known != config:
            raise ValueError(f"{kind} {version} exists with another configuration")
        return False

    def require(self, kind: str, version: str, **expected) -> dict:
        """The configuration of a version, which must have the expected values."""
        if (kind, version) not in self.entries:
            raise ValueError(f"unknown {kind} {version}")
        config = self.entries[kind, version]
        wrong = {k: config.get(k) for k, v in expected.items() if config.get(k) != v}
        if wrong:
            raise ValueError(f"{kind} {version} belongs to {wrong}, not {expected}")
        return config

    def dumps(self) -> str:
        return json.dumps([[*k, v] for k, v in sorted(self.entries.items())], sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Registry:
        return cls({(a, b): c for a, b, c in json.loads(text)})
