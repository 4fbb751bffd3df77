"""Connected components of a table of links, see :mod:`recscan.operators.components`."""

from recscan.operators.components import connected_components

__all__ = ["connected_components"]
