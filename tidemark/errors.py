"""Errors of the public interface."""


class EngineError(Exception):
    """Base of all errors raised by this package."""


class KeyNotFound(EngineError):
    """No live value under the key."""


class VectorNotFound(EngineError):
    """No live vector under the id."""


class Conflict(EngineError):
    """Another writer committed first, or an account or event exists already."""


class InvalidArgument(EngineError):
    """An argument outside its domain."""


class OutOfRange(EngineError):
    """An amount that a long cannot hold."""


class ValueTooLarge(EngineError):
    """A value of the page is larger than the caller allows."""


class LimitExceeded(EngineError):
    """A compaction would rewrite more than its options allow."""


class AccountNotFound(EngineError):
    """No account under the id."""


class PricePlanNotFound(EngineError):
    """No price plan under the id, and no price in the event."""
