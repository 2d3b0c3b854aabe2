"""lexweave: retrieval, catalog, session, graph, span and evaluation analytics as Spark jobs."""

from lexweave.session import build_session

__all__ = ["build_session"]
