"""Registered queries of the scene operators, their SQL, and the relations they run on."""

from __future__ import annotations


def __getattr__(name: str):
    """The registries, filled by importing the query modules when they are first asked for."""
    if name in ("QUERIES", "ORACLE_SQL"):
        from scenelake.plans import mask_queries, point_queries, scene_queries, source_queries  # noqa: F401

        return getattr(scene_queries, name)
    raise AttributeError(name)
