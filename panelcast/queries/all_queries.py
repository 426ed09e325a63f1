"""Every registered query of the library outside the training-text subpackage."""

from __future__ import annotations

from . import evaluate, models, prepare  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
