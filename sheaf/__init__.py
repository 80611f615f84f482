"""Document retrieval and grounded answering on Spark DataFrames; ``sheaf.llm`` prepares training data and is imported apart.

Names are looked up when they are first used, so workers that need one module don't load all.
"""

from importlib import import_module

_HOME = {
    "sheaf.operators.chunking": ["CharChunks", "TokenChunks", "char_chunks", "page_chunks", "section_chunks"],
    "sheaf.operators.enhance": ["enhance"],
    "sheaf.operators.index": ["Index", "IndexFormatError"],
    "sheaf.operators.ranking": ["bm25", "bm25_strict", "enhanced", "exact_matches", "hybrid", "retriever", "strict_index", "tfidf", "vector"],
    "sheaf.plans.config": ["AnswerOptions", "Config", "ConfigError"],
    "sheaf.plans.loading": ["add_documents", "extract", "from_folder", "load_documents"],
    "sheaf.plans.profiles": ["Open", "Strict", "build_pages", "reindex", "status"],
    "sheaf.plans.provider": ["Chat", "ModelConfig", "Provider", "ProviderError", "Retrying"],
    "sheaf.storage": ["clean"],
}
_MODULE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_MODULE[name]), name)
