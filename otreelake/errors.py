"""What goes wrong, by kind."""


class OTreeError(Exception):
    """Any failure of this library."""


class AnalysisError(OTreeError):
    """A request that cannot be carried out as it stands: unknown tables, columns, types or options."""


class CommitConflict(OTreeError):
    """Another writer committed the version first."""
