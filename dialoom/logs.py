"""Logging to a file and to the error stream."""

from __future__ import annotations

import logging

FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def setup(path: str = "project.log", level: int = logging.INFO) -> None:
    """Log to ``path`` and to stderr. Handlers that are there already stay, so it does its work once."""
    logging.basicConfig(level=level, format=FORMAT, handlers=[logging.FileHandler(path), logging.StreamHandler()])
