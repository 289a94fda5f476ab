"""All driver bindings; importing this package fills the registry."""

from paylens.queries import boards, landed, models, pay, places, readers, rules, state, statistics, texts, timeseries  # noqa: F401
from paylens.queries.registry import ORACLE, QUERIES  # noqa: F401
