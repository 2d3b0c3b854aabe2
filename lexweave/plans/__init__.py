"""Registered queries with their SQL twins."""

import importlib

MODULES = ("scalars", "retrieval", "catalog", "documents", "sessions", "evals",
           "accounts", "layout", "graph", "spans", "streams", "files")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"lexweave.plans.{name}")
