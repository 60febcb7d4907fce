"""Errors of the engine; ``kind`` names the class of failure."""


class SearchError(Exception):
    kind = "Internal"


class ParseError(SearchError):
    kind = "Parse"


class NotFound(SearchError):
    kind = "NotFound"


class InvalidArgument(SearchError):
    kind = "InvalidArgument"


class InvalidInput(SearchError):
    kind = "InvalidInput"


class InvalidState(SearchError):
    kind = "InvalidState"


class OutOfMemory(SearchError):
    kind = "OutOfMemory"


class UnsupportedQuery(SearchError):
    kind = "UnsupportedQuery"


class StorageError(SearchError):
    kind = "Io"


class Conflict(InvalidState):
    """Another writer published the version first, or changed what a transaction had read."""
