"""Run settings as dataclasses, overlaid by a JSON (or, where a parser is installed, YAML) mapping."""

import dataclasses
import json


@dataclasses.dataclass
class Paths:
    raw: list[str] = dataclasses.field(default_factory=list)
    output: str = "data/processed"


@dataclasses.dataclass
class Cleaning:
    valid_ratio: float = 0.1
    seed: int = 42


@dataclasses.dataclass
class Pairs:
    max_synthetic: int = 1000
    min_jaccard: float = 0.5
    valid_ratio: float = 0.1
    seed: int = 42


@dataclasses.dataclass
class Settings:
    paths: Paths = dataclasses.field(default_factory=Paths)
    cleaning: Cleaning = dataclasses.field(default_factory=Cleaning)
    pairs: Pairs = dataclasses.field(default_factory=Pairs)
    #: Sections of a file that this engine does not read (models, training), kept as they are.
    others: dict = dataclasses.field(default_factory=dict)

    def to_dict(self) -> dict:
        own = dataclasses.asdict(self)
        return own.pop("others") | own


def overlay(mapping: dict) -> Settings:
    """Settings with the known keys of known sections replaced; unknown keys are ignored, other sections kept for ``to_dict``."""
    settings = Settings()
    for section, values in mapping.items():
        part = getattr(settings, section, None)
        if dataclasses.is_dataclass(part) and isinstance(values, dict):
            for key, value in values.items():
                if key in {f.name for f in dataclasses.fields(part)}:
                    setattr(part, key, value)
        elif isinstance(values, dict) and section != "others":
            settings.others[section] = values
    return settings


def load(path: str) -> Settings:
    """Settings from a file whose root is a mapping; another root raises."""
    with open(path, encoding="utf-8") as text:
        raw = text.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        mapping = yaml.safe_load(raw) or {}
    else:
        mapping = json.loads(raw)
    if not isinstance(mapping, dict):
        raise ValueError("settings must be a mapping")
    return overlay(mapping)
