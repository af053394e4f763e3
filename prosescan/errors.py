"""What can go wrong with dictionaries, paths and inputs."""


class ProseScanError(Exception):
    """Base of all errors of this package."""


class DictionaryLoadError(ProseScanError):
    """A dictionary can't be read or parsed."""


class DictionaryInvalid(ProseScanError):
    """A dictionary was parsed, but its patterns contradict a rule."""


class ExcludeError(ProseScanError):
    """An exclude isn't a glob."""


class SourceError(ProseScanError):
    """An input can't be read as UTF-8 text."""
