"""Errors of pipeline definitions and of rows."""


class PipelineError(ValueError):
    """A pipeline, a config or a schema is not valid; raised before anything runs."""


class CapabilityError(RuntimeError):
    """A client library, jar or service that a connector needs is not there."""


class AssertionFailed(AssertionError):
    """Rows differ from those expected."""
