"""Errors that carry the status code of the request interface."""

from __future__ import annotations


class LogError(Exception):
    status = 500


class BadRequest(LogError):
    status = 400


class NotFound(LogError):
    status = 404


class Overloaded(LogError):
    """The ingest buffer is full; try again after `retry_after` seconds."""

    status = 503

    def __init__(self, message: str = "service temporarily unable to accept writes", retry_after: int = 1):
        super().__init__(message)
        self.retry_after = retry_after


class Busy(LogError):
    """Upkeep of the store is running already."""

    status = 409


class TimedOut(LogError):
    """A query ran longer than it may."""


def response(error: Exception) -> tuple[int, dict[str, str], dict[str, str]]:
    """(status, headers, body) for an error; anything unexpected is an internal error."""
    if not isinstance(error, LogError):
        return 500, {}, {"error": "internal error"}
    headers = {"Retry-After": str(error.retry_after)} if isinstance(error, Overloaded) else {}
    return error.status, headers, {"error": str(error)}
