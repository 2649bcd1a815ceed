"""All checked queries."""

from checks import q_graph, q_hotspots, q_presentation, q_prices, q_sources, q_space  # noqa: F401
from checks.catalog import ORACLE, QUERIES  # noqa: F401
