"""Connected components of an edge table, as the library has them."""

from ..operators.graph import Forest, components

__all__ = ["Forest", "components"]
