"""What can go wrong, one class a cause."""


class VectorStoreError(Exception):
    """Any failure of this package's own."""


class Invalid(VectorStoreError, ValueError):
    """A request that can't be carried out as it stands."""


class CollectionNotFound(VectorStoreError, KeyError):
    """No collection of that name."""


class CollectionExists(VectorStoreError):
    """A collection of that name is there already."""


class StaleRoot(VectorStoreError):
    """Someone else has written since the expected root."""

    def __init__(self, expected: str | None, actual: str | None):
        super().__init__(f"expected root {expected}, found {actual}")
        self.expected, self.actual = expected, actual


class ReadOnly(VectorStoreError):
    """A view of the past takes no writes."""


class Corrupt(VectorStoreError):
    """Stored data that contradicts itself."""


class EmbeddingError(VectorStoreError):
    """An embedder whose answer doesn't fit its question."""
