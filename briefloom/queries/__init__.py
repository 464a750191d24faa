"""The registered queries."""

from briefloom.queries.registry import ORACLES, QUERIES  # noqa: F401
from briefloom.queries import texts  # noqa: F401
from briefloom.queries import checks  # noqa: F401
from briefloom.queries import budgets  # noqa: F401
from briefloom.queries import planning  # noqa: F401
from briefloom.queries import replays  # noqa: F401
from briefloom.queries import structure  # noqa: F401
from briefloom.queries import pages  # noqa: F401
from briefloom.queries import edits  # noqa: F401
from briefloom.queries import requests  # noqa: F401
from briefloom.queries import streams  # noqa: F401
