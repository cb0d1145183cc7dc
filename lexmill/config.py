"""Engine configuration: one frozen record read from a mapping such as os.environ.

Values that don't parse fall back to their defaults; each fallback is named in ``warnings``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Roles that an override of a note type's fields may name.
OVERRIDE_ROLES = ("headword_field", "hanja_field", "jyutping_field", "english_field", "sentence_field")
PROVIDERS = ("openai", "openrouter", "anthropic", "local", "deepseek")
PREFIX = "LEXMILL_"


@dataclass(frozen=True)
class EngineConfig:
    provider: str = "openai"
    tokens_per_minute: int = 30_000
    requests_per_minute: int = 50
    max_retries: int = 4
    timeout_s: float | None = 300.0
    max_output_tokens: int = 4096
    chunk_tokens: int = 20_000
    chunk_output_ratio: float = 0.25
    price_in: float | None = None
    price_out: float | None = None
    pattern_marker: str = "~"
    json_snippet: int = 800
    deck_path: str = ""
    deck_name: str = ""
    deck_field: int | str = 0
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    watch_dir: str = "./watch"
    output_dir: str = "./inputs"
    processed_dir: str = "./processed"
    log_dir: str = "./logs"
    log_retention_days: int = -1
    warnings: tuple[str, ...] = ()

    @property
    def extract_chunk_tokens(self) -> int:
        """Budget of one extraction chunk: a share of what the model may answer, between bounds."""
        room = max(512, self.max_output_tokens - 256)
        return min(self.chunk_tokens, max(256, int(room * self.chunk_output_ratio)))

    @property
    def prices(self) -> tuple[float, float] | None:
        """Prices per million tokens; a single one leaves the other at 0, none means unpriced."""
        if self.price_in is None and self.price_out is None:
            return None
        return self.price_in or 0.0, self.price_out or 0.0


def parse_overrides(text: str) -> tuple[dict[str, dict[str, str]], list[str]]:
    """{model: {role: field}} with unknown roles and values that aren't names dropped."""
    try:
        raw = json.loads(text) if text.strip() else {}
    except ValueError:
        return {}, ["overrides are not JSON"]
    if not isinstance(raw, dict):
        return {}, ["overrides are not an object"]
    out: dict[str, dict[str, str]] = {}
    notes = []
    for model, roles in raw.items():
        if not isinstance(roles, dict):
            notes.append(f"overrides of {model!r} are not an object")
            continue
        for role, name in roles.items():
            if role in OVERRIDE_ROLES and isinstance(name, str) and name.strip():
                out.setdefault(model, {})[role] = name.strip()
            else:
                notes.append(f"override {model!r}.{role!r} is dropped")
    return out, notes


def parse_field(text: str) -> int | str:
    """A field by number (negative ones count as 0) or by name; blank is the first."""
    text = text.strip()
    try:
        return max(0, int(text))
    except ValueError:
        return text or 0


def load_config(env: Mapping[str, str], lang: str = "") -> EngineConfig:
    """Configuration from ``env``; a name with the language's suffix wins over the plain one."""
    notes: list[str] = []

    def raw(name: str) -> str:
        own = env.get(f"{PREFIX}{name}_{lang.upper()}", "").strip() if lang else ""
        return own or env.get(PREFIX + name, "").strip()

    def number(name, kind, default, least=None, most=None):
        text = raw(name)
        if not text:
            return default
        try:
            value = kind(text)
        except ValueError:
            notes.append(f"{name}={text!r} is not a number")
            return default
        if least is not None:
            value = max(least, value)
        return value if most is None else min(most, value)

    provider = raw("PROVIDER").lower() or "openai"
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    timeout = number("TIMEOUT", float, 300.0)
    overrides, more = parse_overrides(raw("OVERRIDES"))
    notes += more
    return EngineConfig(
        provider=provider,
        tokens_per_minute=number("TPM", int, 30_000, least=0),
        requests_per_minute=number("RPM", int, 50, least=0),
        max_retries=number("RETRIES", int, 4, least=0),
        timeout_s=timeout if timeout > 0 else None,
        max_output_tokens=number("MAX_OUTPUT_TOKENS", int, 4096, least=1),
        chunk_tokens=number("CHUNK_TOKENS", int, 20_000, least=1),
        chunk_output_ratio=number("CHUNK_RATIO", float, 0.25, least=0.05, most=1.0),
        price_in=number("PRICE_IN", float, None),
        price_out=number("PRICE_OUT", float, None),
        pattern_marker=raw("MARKER") or "~",
        json_snippet=number("SNIPPET", int, 800, least=80),
        deck_path=raw("DECK_PATH"),
        deck_name=raw("DECK"),
        deck_field=parse_field(raw("DECK_FIELD")),
        overrides=overrides,
        watch_dir=raw("WATCH_DIR") or "./watch",
        output_dir=raw("OUTPUT_DIR") or "./inputs",
        processed_dir=raw("PROCESSED_DIR") or "./processed",
        log_dir=raw("LOG_DIR") or "./logs",
        log_retention_days=number("LOG_RETENTION", int, -1),
        warnings=tuple(notes),
    )
