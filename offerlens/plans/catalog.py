"""All registered queries; importing the modules registers them."""

from offerlens.plans import events, histories, learning, ranking, serving, tables, timing  # noqa: F401
from offerlens.plans.registry import ORACLES, QUERIES  # noqa: F401
