"""Errors of the library, by what went wrong."""

from __future__ import annotations


class PaperloomError(RuntimeError):
    """Base of all errors raised on purpose."""


class ConfigurationError(PaperloomError):
    """A setting is missing or contradicts another."""


class ExtractionError(PaperloomError):
    """A document can't be read."""


class ParserServiceError(ExtractionError):
    """The structured parser of PDF files is unavailable or refused a file."""


class LookupServiceError(ExtractionError):
    """Identifiers can't be resolved, or a record can't be fetched or parsed."""


class PageTextError(ExtractionError):
    """The fallback over page texts gave no document."""


class ServiceError(PaperloomError):
    """An outside service answered with an error: its HTTP status, if any, and how long it asks to wait."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after
