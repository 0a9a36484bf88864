"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class NotFound(EngineError):
    """An index, record, blob or job does not exist."""


class Duplicate(EngineError):
    """A key exists already."""


class Conflict(EngineError):
    """A table was replaced by another writer meanwhile."""


class InvalidParameter(EngineError):
    """A parameter is out of range or malformed; ``field`` names it."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field
        self.message = message


class RateLimited(EngineError):
    """Too many requests; ``retry_after_ms`` says when to try again."""

    def __init__(self, retry_after_ms: int):
        super().__init__(f"retry after {retry_after_ms} ms")
        self.retry_after_ms = retry_after_ms
