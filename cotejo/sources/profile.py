"""The profile of a source: what it allows, how fast it may be asked, which strata its documents have."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    entity: str
    hosts: tuple[str, ...]
    sections: tuple[str, ...]
    strata: tuple[str, ...]
    boilerplate: tuple[str, ...]
    seconds_between_requests: float
    coherence: float
    third_parties: bool


def load_profile(path: str) -> Profile:
    """Reads a YAML profile. A missing or unknown field, a value of the wrong kind or out of range is an error that names the field."""
    import yaml

    given = yaml.safe_load(Path(path).read_text())
    names = Profile.__dataclass_fields__
    if not isinstance(given, dict) or set(given) != set(names):
        raise ValueError(f"{path}: fields {sorted(set(names) ^ set(given if isinstance(given, dict) else []))}")
    for f in ("hosts", "sections", "strata", "boilerplate"):
        if not isinstance(given[f], list) or not all(isinstance(x, str) for x in given[f]):
            raise ValueError(f"{path}: {f} must be a list of texts")
        given[f] = tuple(given[f])
    if not isinstance(given["entity"], str) or not given["entity"]:
        raise ValueError(f"{path}: entity must be a text")
    for f, low, high in (("seconds_between_requests", 0, 3600), ("coherence", 0, 1)):
        if isinstance(given[f], bool) or not isinstance(given[f], (int, float)) or not low <= given[f] <= high:
            raise ValueError(f"{path}: {f} must lie between {low} and {high}")
    if not isinstance(given["third_parties"], bool):
        raise ValueError(f"{path}: third_parties must be true or false")
    return Profile(**given)
