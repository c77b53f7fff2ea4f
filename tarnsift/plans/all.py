"""All queries, once their modules are imported."""

from tarnsift.plans import graphs, mutations, relational, retrieval  # noqa: F401
from tarnsift.plans.registry import QUERIES, SQL  # noqa: F401
