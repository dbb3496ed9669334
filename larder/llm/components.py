"""Connected components with the operators' own workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.llm.common import Workspace
from larder.operators import components


def connected_components(edges: DataFrame, space: Workspace, label: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst long), see larder.operators.components."""
    return components.connected_components(edges, space.write, space.drop, label)
