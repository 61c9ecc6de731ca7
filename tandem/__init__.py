"""Tandem: a PySpark engine for parallel-corpus building and translation evaluation."""

from tandem.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
