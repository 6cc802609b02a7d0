"""Settings of indexing, retrieval and answering."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default sizes that results depend on.
EMBEDDING_DIM = 768
CHUNK_TOKENS = 512
DENSE_K = 10
SPARSE_K = 5
RERANK_K = 3
SUMMARY_SENTENCES = 3
METRIC_BATCH = 4
TEST_SHARE = 0.2
SPLIT_SEED = 42
PQ_SUBVECTORS = 16
PQ_BITS = 8
RECALL = 0.95

INDEX_TYPES = ("exact", "hnsw", "hnsw_pq")
MODES = ("validation", "inference")


@dataclass(frozen=True)
class IndexConfig:
    """``hnsw`` asks for approximate search, ``hnsw_pq`` for compressed approximate search.

    ``hnsw`` is served by the neighbour graph of ``operators.graph`` where the corpus has its links, else by cells.
    """

    index_type: str = "hnsw"
    n_cells: int = 64
    # Cells that each query looks at; None calibrates them by brute force until ``recall`` of the true neighbours is found.
    n_probe: int | None = None
    recall: float = RECALL
    # Pairs that a graph search keeps for each query; None calibrates them like the cells.
    beam: int | None = None
    pq_m: int = PQ_SUBVECTORS
    pq_bits: int = PQ_BITS
    rescore: int = 8
    # Share of the vectors that k-means is trained on; every vector is indexed in any case.
    train_share: float = 1.0

    def __post_init__(self) -> None:
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {self.index_type!r}, expected one of {INDEX_TYPES}")


@dataclass(frozen=True)
class RetrievalConfig:
    dense_k: int = DENSE_K
    sparse_enabled: bool = False
    sparse_k: int = SPARSE_K
    rerank_enabled: bool = True
    rerank_k: int = RERANK_K
    # Which text the reranker sees when only the dense channel runs. With both channels it is always the original.
    rerank_query: str = "original"
    hyde_enabled: bool = True
    summary_enabled: bool = True
    dedup: bool = False
    index: IndexConfig = field(default_factory=lambda: IndexConfig(index_type="exact"))

    def __post_init__(self) -> None:
        if self.rerank_query not in ("original", "expanded"):
            raise ValueError(f"rerank_query must be 'original' or 'expanded', not {self.rerank_query!r}")
