"""Every query of the library by name, with its SQL where SQL can express it."""

from loomline.plans import overview, topics  # noqa: F401  topics adds its own to the same tables

QUERIES: dict = overview.QUERIES
ORACLES: dict = overview.ORACLES
