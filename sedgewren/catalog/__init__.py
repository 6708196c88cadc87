"""Named queries over the driver's tables, with the equivalent SQL."""

from . import audits, campaigns, chains, factors, gates, intervals, panels, reports, status, streams, validation  # noqa: F401  these add to the queries of panels

QUERIES = {**factors.QUERIES, **panels.QUERIES}
ORACLES = {**factors.ORACLES, **panels.ORACLES}
