"""All registered queries (importing the modules fills ``QUERIES``)."""

from . import queries_prep, queries_rec, queries_seq  # noqa: F401
from .registry import QUERIES  # noqa: F401
