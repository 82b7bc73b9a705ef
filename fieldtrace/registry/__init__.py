"""All registered queries; importing the package fills ``BOOK``."""

from fieldtrace.registry import dense, evaluation, preparation, sequences, skewed, storage  # noqa: F401
from fieldtrace.registry.book import BOOK

__all__ = ["BOOK"]
