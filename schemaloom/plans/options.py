"""Options of a conversion. Keys may be written in snake, kebab or camel case."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

TARGETS = ("openai-strict", "gemini", "claude")
MODES = ("strict", "permissive")
POLYMORPHISM = ("any-of", "flatten")


@dataclass(frozen=True)
class Options:
    target: str = "openai-strict"
    mode: str = "strict"
    max_depth: int = 50
    recursion_limit: int = 3
    polymorphism: str = "any-of"
    skip_components: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (("target", TARGETS), ("mode", MODES), ("polymorphism", POLYMORPHISM)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")

    @classmethod
    def of(cls, given: dict | Options | None = None) -> Options:
        if isinstance(given, Options):
            return given
        known = {f.name for f in fields(cls)}
        out = {}
        for key, value in (given or {}).items():
            name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).replace("-", "_").lower()
            if name not in known:
                raise ValueError(f"unknown option {key}")
            out[name] = value
        return cls(**out)

    @property
    def strict_target(self) -> bool:
        return self.target == "openai-strict" and self.mode == "strict"
