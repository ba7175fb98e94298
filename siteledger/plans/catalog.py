"""The registered queries and their SQL."""

from siteledger.plans import commerce, derived, site

QUERIES: dict = {**site.QUERIES, **commerce.QUERIES, **derived.QUERIES}
ORACLES: dict[str, str] = {**site.ORACLES, **commerce.ORACLES, **derived.ORACLES}
