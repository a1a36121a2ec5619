"""Errors raised for invalid requests and failed quality gates."""

from __future__ import annotations

# The error codes of the query surface.
ERROR_CODES = (
    "INVALID_REQUEST",
    "UNSUPPORTED_FIELD",
    "INVALID_FILTER_VALUE",
    "DATA_NOT_READY",
    "NOT_FOUND",
    "AMBIGUOUS_IDENTIFIER",
    "UNKNOWN_DATASET",
)


class QueryError(Exception):
    """A market question that cannot be answered; ``code`` is one of ERROR_CODES."""

    def __init__(self, code: str, message: str, **details: object) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.details = details


class QualityError(Exception):
    """A batch that must not be published."""


class SchemaMismatch(QualityError):
    """A feed whose columns differ from the declared schema."""
