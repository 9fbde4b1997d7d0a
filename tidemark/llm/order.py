"""Places of rows in a global order, as the library has them."""

from tidemark.operators.order import positions

__all__ = ["positions"]
