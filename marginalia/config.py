"""Engine parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields


class EngineError(Exception):
    """Base of the engine's errors."""


class ValidationError(EngineError):
    """An input path or parameter can't be used."""


class ConfigError(EngineError):
    """A configuration lacks a value or has a wrong one."""


class CredentialError(EngineError):
    """A service's key is missing or refused."""


class SourceError(EngineError):
    """A source can't be read."""


class RecognitionError(SourceError):
    """Text recognition on an image failed."""


class ExtractionError(SourceError):
    """Text could not be taken from a source."""


class StructureError(EngineError):
    """No structure could be made of a document's elements."""


class ChunkingError(EngineError):
    """A text could not be cut into chunks."""


class ModelError(EngineError):
    """A model failed or gave an answer that can't be read."""


class AnnotationError(EngineError):
    """Quotes could not be marked in a document."""


@dataclass(frozen=True)
class EngineConfig:
    region_padding: float = 0.3
    line_break_factor: float = 0.6
    sentinel_height: float = 1000.0
    chunk_chars: int = 50_000
    chunk_overlap: int = 100
    min_snippet_words: int = 5
    match_floor: float = 0.6
    match_stop: float = 0.95
    cue_match_floor: float = 0.4
    single_prompt_words_book: int = 8192
    single_prompt_words_audio: int = 8000
    cue_max_chars: int = 120
    cue_max_gap: float = 1.5
    merge_gap_ms: int = 1000
    clip_tail_ms: int = 100
    max_chapter_length: int = 3500

    @classmethod
    def from_file(cls, path: str) -> "EngineConfig":
        """From a JSON file, or a YAML file if a YAML parser is installed; sections are flattened."""
        import json

        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("reading YAML needs a YAML parser") from e
            values = yaml.safe_load(text)
        else:
            try:
                values = json.loads(text)
            except ValueError as e:
                raise ConfigError(f"not JSON: {path}") from e
        if not isinstance(values, dict):
            raise ConfigError(f"no mapping in {path}")
        flat = {k: v for k, v in values.items() if not isinstance(v, dict)}
        for v in values.values():
            if isinstance(v, dict):
                flat |= v
        return cls.from_mapping(flat)

    @classmethod
    def from_mapping(cls, values: dict) -> "EngineConfig":
        """From a parsed YAML or JSON mapping; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})
