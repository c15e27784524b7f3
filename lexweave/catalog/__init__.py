"""Named queries over the given tables, each with SQL that computes the same where SQL can."""

from lexweave.catalog import models, sources, texts, topics, vocabularies  # noqa: F401
from lexweave.catalog.base import REGISTRY
