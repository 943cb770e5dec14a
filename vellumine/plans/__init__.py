"""All queries of the document engine; importing a module of plans registers its queries."""

from vellumine.plans import conversion, documents, pages, routing, scalars, stored, structure, styles, tables  # noqa: F401
from vellumine.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
