"""The item fact: every kind of policy item of every export in one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import exports
from .items import resource_items
from .stage import stage
from .tags import tag_items, tag_set_items


def policy_items(
    policies: DataFrame,
    resources: DataFrame | None = None,
    definitions: DataFrame | None = None,
    catalog: str = "main",
) -> DataFrame:
    """Union of all item kinds; ``seq`` gives the order inside an export."""
    items = resource_items(policies, catalog)
    if resources is not None:
        items = items.unionByName(tag_items(policies, resources, catalog))
        if definitions is not None:
            items = items.unionByName(tag_set_items(resources, definitions, catalog))
    return items


def items_of_documents(documents: DataFrame, catalog: str = "main") -> DataFrame:
    """Item fact straight from ``(export_id, document)`` rows. Documents are parsed once: three kinds
    of rows are read from what was opened."""
    opened = stage(exports.open_documents(documents))
    return policy_items(
        exports.policy_rows(opened),
        exports.tag_resources(opened),
        exports.tag_definitions(opened),
        catalog,
    )
