"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from . import base, corpus, gate, misc, routing, streaming, usage  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
