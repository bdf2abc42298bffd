"""Errors of the library; each keeps its message."""


class CorpusError(ValueError):
    """Base of all errors about corpora and models."""


class InputError(CorpusError):
    """An input file or row is not of the promised form."""


class UnknownClassError(CorpusError):
    """A label is not in the class map."""


class UnknownMethodError(CorpusError):
    """A method name (scaling, distance, averaging) is not known."""


class ParameterError(CorpusError):
    """A size, count or fraction is out of range."""


class NotConvergedError(CorpusError):
    """The loop limit was reached before the fit converged."""


class NotTrainedError(CorpusError):
    """A model is asked for results before it was trained."""
