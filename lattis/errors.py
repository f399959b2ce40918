"""Errors of the dialect. The session answers them with "failure", or "abort" where a transaction is rolled back."""


class EngineError(Exception):
    """A statement can't be run."""


class SyntaxFault(EngineError):
    """The text isn't a statement of the dialect."""


class TableNotFound(EngineError):
    pass


class TableExists(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class AmbiguousColumn(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class IndexExists(EngineError):
    pass


class ValueCountMismatch(EngineError):
    pass


class StringTooLong(EngineError):
    pass


class IncompatibleType(EngineError):
    pass


class DuplicateKey(EngineError):
    pass


class Conflict(EngineError):
    """A transaction has to be rolled back: a write conflict or a dangerous structure."""
