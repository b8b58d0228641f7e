"""Records as clients see them: wire names, without what is internal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.levels import level_name

#: Fixed names: for each resource its wire names and the columns that they are made of.
NAMES: dict[str, dict[str, str]] = {
    "workspace": {"id": "name", "metadata": "metadata", "configuration": "configuration", "created_at": "created_at"},
    "peer": {"id": "name", "workspace_id": "workspace", "metadata": "metadata", "configuration": "configuration", "created_at": "created_at"},
    "session": {"id": "name", "workspace_id": "workspace", "is_active": "is_active", "metadata": "metadata", "configuration": "configuration", "created_at": "created_at"},
    "message": {"id": "id", "workspace_id": "workspace", "session_id": "session", "peer_id": "peer", "content": "content", "token_count": "token_count", "metadata": "metadata", "created_at": "created_at"},
    "conclusion": {"id": "id", "content": "content", "observer_id": "observer", "observed_id": "observed", "session_id": "session", "level": "level", "times_derived": "times_derived", "source_ids": "source_ids", "created_at": "created_at"},
}


def wire(rows: DataFrame, resource: str) -> DataFrame:
    """Rows with the wire names of a resource, as far as they have the columns; levels by name."""

    def column(name: str, source: str) -> Column:
        own = F.col(source)
        return (level_name(own) if name == "level" else own).alias(name)

    return rows.select(*[column(name, source) for name, source in NAMES[resource].items() if source in rows.columns])
