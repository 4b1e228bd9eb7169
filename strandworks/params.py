"""Parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass

#: Decimal byte suffixes and the largest input of the model.
SUFFIXES = {"K": 10**3, "M": 10**6, "G": 10**9}
MOST_SAMPLES = 60_000_000


def byte_count(text: str) -> int:
    """'500M' -> 500,000,000."""
    tail = text[-1:].upper()
    return int(text[:-1]) * SUFFIXES[tail] if tail in SUFFIXES else int(text)


@dataclass(frozen=True)
class JobParams:
    """Chunking and batching of one job; the defaults are those of a usual run."""

    chunk_size: int = 10_000
    overlap: int = 150
    stride: int = 1
    batch_chunks: int = 500
    batch_reads: int = 2_000

    def __post_init__(self) -> None:
        for name in ("chunk_size", "overlap", "stride", "batch_chunks", "batch_reads"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.overlap >= self.samples:
            raise ValueError("overlap must be smaller than the chunk size")
        if self.chunk_size * self.batch_chunks > MOST_SAMPLES:
            raise ValueError(f"chunk_size * batch_chunks must not exceed {MOST_SAMPLES}")

    @property
    def samples(self) -> int:
        """Chunk size rounded down to whole strides."""
        return self.chunk_size - self.chunk_size % self.stride

    @property
    def step(self) -> int:
        return self.samples - self.overlap
