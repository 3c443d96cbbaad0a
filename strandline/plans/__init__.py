"""The registered queries on the standard tables, and SQL that says the same."""

from strandline.plans import catalogue, filesystem, metadata, storage

__all__ = ["catalogue", "filesystem", "metadata", "storage"]
