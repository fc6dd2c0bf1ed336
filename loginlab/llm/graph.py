"""Connected components of numbered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loginlab.llm.common import shared_folder
from loginlab.operators import components as linked

LINKS_PER_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """⟨node, component⟩ of ⟨a, b⟩ (longs): a component is named by its smallest node."""
    shared_folder(edges.sparkSession)
    return linked.components(edges, LINKS_PER_TASK)
