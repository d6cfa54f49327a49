"""The registered queries of the library."""

from boardloom.plans import arrivals, boards, calendar, carries, dimensions, exports, families, groups, play, reports, sampling, store  # noqa: F401
from boardloom.plans.registry import ORACLES, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict:
    return dict(ORACLES)
