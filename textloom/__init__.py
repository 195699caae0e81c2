"""Semantic chunking of documents on Spark."""

from importlib import import_module

_HOME = {
    "UNBOUNDED": "functions.config",
    "Capacity": "functions.config",
    "CapacityError": "functions.config",
    "Chunk": "operators.kernel",
    "ChunkConfig": "functions.config",
    "CodeChunker": "operators.chunkers",
    "LanguageError": "functions.config",
    "MarkdownChunker": "operators.chunkers",
    "OverlapError": "functions.config",
    "TextChunker": "operators.chunkers",
}

__all__ = list(_HOME)


def __getattr__(name: str):
    """Imported at first use, so that a worker loads only what it runs."""
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
