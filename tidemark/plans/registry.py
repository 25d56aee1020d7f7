"""All registered queries of the library's own operators, by name, with their SQL twins."""

from . import corpus, feeds, matching, model, onboarding, relational, sessions, text  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
