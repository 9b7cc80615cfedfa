"""Job settings."""

import json
from dataclasses import dataclass, field

# The usual patterns for marginalia comments, one per context label. The
# label is the last capture group.
CONTEXT_PATTERNS = {
    "controller": r"/\*.*controller(_with_namespace)?:([^,]+).*\*/",
    "action": r"/\*.*action:([^,]+).*\*/",
    "job_tag": r"/\*.*job(_tag)?:([^,]+).*\*/",
}

# Setting names of the JSON file -> attribute.
_SETTINGS = {
    "ObservationInterval": "observation_interval",
    "StatusInterval": "status_interval",
    "SanityCheck": "sanity_check",
    "FQDN": "fqdn",
    "Project": "project",
    "Environment": "environment",
    "Cluster": "cluster",
    "Role": "role",
}
# Settings of this library in the same file.
_OWN_SETTINGS = {"TopK": "top_k", "RetentionDays": "retention_days"}
_PATTERN_SETTINGS = {
    "ContextController": "controller",
    "ContextAction": "action",
    "ContextJob": "job_tag",
}


@dataclass(frozen=True)
class JobConfig:
    """What a collecting job needs to know: who is observed, how often, and which plug-ins."""

    observation_interval: int = 300
    status_interval: int = 60
    sanity_check: str | None = None
    fqdn: str | None = None
    project: str | None = None
    environment: str | None = None
    cluster: str | None = None
    role: str | None = None
    context_patterns: dict[str, str] = field(default_factory=lambda: dict(CONTEXT_PATTERNS))
    top_k: int | None = 100
    retention_days: int = 21

    @classmethod
    def from_json(cls, text: str) -> "JobConfig":
        """Read the JSON settings; connection settings in the same file are ignored."""
        raw = json.loads(text)
        values = {attr: raw[name] for name, attr in {**_SETTINGS, **_OWN_SETTINGS}.items() if name in raw}
        patterns = {label: raw.get(name, "") for name, label in _PATTERN_SETTINGS.items()}
        return cls(**values, context_patterns=patterns)

    @property
    def source(self) -> dict[str, str | None]:
        return {
            "project": self.project,
            "environment": self.environment,
            "cluster": self.cluster,
            "role": self.role,
            "fqdn": self.fqdn,
        }

    @property
    def flush_interval(self) -> int:
        """Seconds between two writes of the running statistics."""
        return 2 * self.observation_interval
