"""Settings of a run: defaults, a file, then flags; validated."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

#: Names of settings files, in the order in which they are looked for.
NAMES = ("lodestrand.config.json", "lodestrand.json")
METHODS, BACKENDS = ("sft", "dpo", "grpo"), ("auto", "cuda", "mlx")


@dataclass(frozen=True)
class Settings:
    site: str = "this website"
    input: str = "docs"
    output: str = ".lodestrand"
    method: str = "sft"
    backend: str = "auto"
    max_chars: int = 2000
    overlap: int = 200
    min_chars: int = 400
    max_pairs: int = 5000
    holdout: float = 0.05
    models: tuple = field(default_factory=tuple)

    def validate(self) -> list[str]:
        wrong = []
        if self.method not in METHODS:
            wrong.append(f"method is one of {', '.join(METHODS)}")
        if self.backend not in BACKENDS:
            wrong.append(f"backend is one of {', '.join(BACKENDS)}")
        if not 0 <= self.holdout < 1:
            wrong.append("holdout is at least 0 and below 1")
        if not 0 <= self.overlap < self.max_chars:
            wrong.append("overlap is below max_chars")
        ids = [m.get("id") for m in self.models]
        if len(set(ids)) != len(ids):
            wrong.append("models have different ids")
        return wrong


def load(folder: str = ".", **flags) -> Settings:
    """Flags over the first settings file over defaults; unknown names are refused."""
    known = {f.name for f in fields(Settings)}
    found: dict = {}
    for name in NAMES:
        if (path := Path(folder, name)).exists():
            found = json.loads(path.read_text())
            break
    both = found | {k: v for k, v in flags.items() if v is not None}
    if extra := set(both) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    if "models" in both:
        both["models"] = tuple(both["models"])
    out = replace(Settings(), **both)
    if wrong := out.validate():
        raise ValueError("; ".join(wrong))
    return out


def chat_options(options: dict | None = None) -> dict:
    """Decoding options within their ranges, defaults where one is missing or no number."""
    #: Fixed values: (default, least, most).
    ranges = {"temperature": (0.3, 0.0, 2.0), "top_p": (0.9, 0.0, 1.0), "max_tokens": (256, 16, 2048), "repetition_penalty": (1.1, 1.0, 2.0)}
    out = {}
    for name, (default, low, high) in ranges.items():
        value = (options or {}).get(name)
        good = isinstance(value, int | float) and not isinstance(value, bool) and value == value
        out[name] = min(high, max(low, value)) if good else default
    return out


def decoding(override: dict | None, manifest: dict | None, settings: dict | None) -> dict:
    """The first block that is given counts as a whole."""
    return next((chat_options(b) for b in (override, manifest, settings) if b), chat_options())


def as_dict(s: Settings) -> dict:
    return asdict(s)
