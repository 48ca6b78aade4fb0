"""Errors that callers can tell apart. The command line reports any of them with exit code 1."""


class LipikaError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(LipikaError):
    """A setting or argument is wrong or missing."""


class VocabSizeError(ConfigError):
    """A vocabulary is too small for its alphabet."""


class NormalizationError(LipikaError):
    """The input is not text."""


class EmptyCorpusError(LipikaError):
    """No usable text."""


class TrainingError(LipikaError):
    """A vocabulary could not be learned."""


class EncodeError(LipikaError):
    """A text could not be encoded."""


class DecodeError(LipikaError):
    """Ids could not be decoded."""


class FeaturizeError(LipikaError):
    """A chunk has no syllable structure."""


class LoadError(LipikaError):
    """A saved artefact is missing or damaged."""


def require(condition: bool, message: str, kind: type[LipikaError] = ConfigError) -> None:
    """Raise ``kind`` unless the condition holds."""
    if not condition:
        raise kind(message)
