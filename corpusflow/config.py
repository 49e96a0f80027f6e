"""Parameters of retrieval and chunking.  The numbers are fixed values of the query semantics."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    recall_k: int = 10
    rrf_k: int = 60
    fusion_limit: int = 10
    final_limit: int = 10
    rerank_documents: int = 100
    rerank_chars: int = 4000
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6


@dataclass(frozen=True)
class Federation:
    subtasks_per_source: int = 3
    results_per_request: int = 5
    final_limit: int = 10
    title_similarity: float = 0.88


@dataclass(frozen=True)
class Chunking:
    overlap: int = 150
    pages_per_batch: int = 3
    separators: tuple = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", " ", "")


#: Weight of a term's occurrence in each field.
FIELD_WEIGHTS = {"title": 8.0, "abstract": 3.0, "keywords": 6.0, "section_title": 4.0, "chunk_text": 1.0, "search_text": 0.6}
