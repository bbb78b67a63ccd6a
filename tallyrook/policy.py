"""What a deployment fixes: limits, windows and rules. Thresholds without a documented value have no default."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

MIB = 1 << 20
#: Fields of an event, and those that a captured envelope must or must not have.
EVENT_FIELDS = ("event_id", "tool", "session_id", "ts", "prompt", "identity", "repo", "branch", "commit")
ENVELOPE_REQUIRED = ("session_id", "turn_id", "cwd", "permission_mode", "prompt")
ENVELOPE_FORBIDDEN = ("agent_id", "agent_type")
#: Redaction rules as (pattern, replacement), in the syntax that Java and RE2 share.
REDACTION = (
    (r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_.=-]{6,}""", "$1[REDACTED]"),
    (r"AKIA[A-Z0-9]{16,}", "[REDACTED]"),
)


@dataclass(frozen=True)
class Policy:
    """The validated configuration. extra_rules stays empty: rules are fixed for all."""

    endpoint: str = ""
    local_store: bool = True
    auto_enroll: bool = True
    redact: bool = True
    extra_rules: tuple = ()
    retention_days: int = 365
    correlation_minutes: int = 10
    recovery_minutes: int = 30
    batch_rows: int = 10_000
    batch_bytes: int = 64 * MIB
    line_bytes: int = 8 * MIB
    envelope_bytes: int = 8 * MIB
    prompt_bytes: int = MIB
    mark: str = "…[TRUNCATED]"

    def __post_init__(self) -> None:
        if self.extra_rules:
            raise ValueError("extra_rules must stay empty")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (not isinstance(value, int) or isinstance(value, bool) or value <= 0):
                raise ValueError(f"{f.name} must be a positive whole number")
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} must be true or false")

    @staticmethod
    def from_json(text: str) -> Policy:
        """Strict: unknown and repeated keys are errors."""

        def once(pairs: list) -> dict:
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("a key is repeated")
            return dict(pairs)

        data = json.loads(text, object_pairs_hook=once)
        unknown = set(data) - {f.name for f in fields(Policy)}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return Policy(**data | ({"extra_rules": tuple(data["extra_rules"])} if "extra_rules" in data else {}))


def check_name(name: str) -> str:
    """A user or tool name that is safe as a folder's name."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name
