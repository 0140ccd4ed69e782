"""Tables cut from their lineage (kinloom.store)."""

from kinloom.store import discard, materialize, shared_dir  # noqa: F401
