"""Named queries over the test tables, each with its SQL."""

from . import cells, commits, composite_cells, dates, learning, mapped, names, reads, records, shapes, statements, stitches, streams
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cells", "commits", "composite_cells", "dates", "learning", "mapped", "names", "reads", "records", "shapes", "statements", "stitches", "streams"]
