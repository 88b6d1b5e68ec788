"""Errors of graphs, runs and channels."""


class StreamError(RuntimeError):
    """A run failed in a node."""

    def __init__(self, node: str, cause: Exception | str) -> None:
        super().__init__(f"node {node} failed: {cause}")
        self.node, self.cause = node, cause


class GraphMismatch(ValueError):
    """Streams of different graphs were combined."""


class ChannelError(RuntimeError):
    """A channel's protocol was broken, or it is closed."""


class LiveOnly(ChannelError):
    """The source needs a live run."""


class AsyncIoError(RuntimeError):
    """A producer or consumer task failed, ended early or did not end in time; kind says which."""

    def __init__(self, kind: str, cause: Exception | str) -> None:
        super().__init__(f"{kind}: {cause}")
        self.kind, self.cause = kind, cause
