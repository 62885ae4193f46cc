"""Typed errors of plans and queries."""


class EngineError(Exception):
    """Base of this package's errors."""


class InvalidArgument(EngineError):
    """A plan or option that can't be accepted."""


class NotFound(EngineError):
    """An unknown id."""


class FailedPrecondition(EngineError):
    """The query isn't in a state that allows this."""


class AlreadyFragmented(InvalidArgument):
    """A plan that is to be cut has been cut before."""


class NotExecutable(InvalidArgument):
    """A plan node that says too little to be run."""
