from . import index, logs, search, tools  # noqa: F401  registers their queries
from .base import QUERIES, SQL  # noqa: F401
