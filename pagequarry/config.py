"""Settings as frozen sections, with checked overrides of the form section.field=value."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

from pagequarry.operators.memory import Budget
from pagequarry.operators.retrieval import Settings


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 64
    min_heading_tokens: int = 32
    table_rows: int = 50
    chart_points: int = 30


@dataclass(frozen=True)
class Config:
    retrieval: Settings = field(default_factory=Settings)
    chunking: Chunking = field(default_factory=Chunking)
    memory: Budget = field(default_factory=Budget)


def parse_value(text: str):
    """true/false, then whole numbers, then numbers, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_overrides(items: list[str]) -> dict[str, object]:
    """'a.b=1' items as a dict; items without "=" are ignored."""
    return {k.strip(): parse_value(v.strip()) for k, _, v in (x.partition("=") for x in items if "=" in x)}


def override(config: Config, changes: dict[str, object]) -> Config:
    """A config with section.field values replaced; an unknown section or field is an error."""
    for path, value in changes.items():
        section, _, name = path.partition(".")
        part = getattr(config, section, None)
        if not is_dataclass(part):
            raise ValueError(f"unknown section: {section}")
        if name not in {f.name for f in fields(part)}:
            raise ValueError(f"unknown field: {path}")
        config = replace(config, **{section: replace(part, **{name: value})})
    return config
