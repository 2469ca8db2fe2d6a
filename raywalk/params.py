"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

#: Records of a chunk at most, unless its reach is longer.
LARGEST = 1 << 17


@dataclass(frozen=True)
class Params:
    """``length``: subsequence length L; ``convolution``: width c of the sliding sums; ``segments``: number of
    rays S; ``query``: path length q; ``grid``: density points on a ray; ``scale``: extent over the largest
    coordinate; ``chunk``: records that a task works on at once, or 0 to choose by the length of the series; ``naive``: add up
    every frame of the sliding sums, path scores and means anew, to measure or check the running sums by."""

    length: int = 50
    convolution: int = 16
    segments: int = 50
    query: int = 75
    grid: int = 250
    scale: float = 1.2
    chunk: int = 0
    naive: bool = False

    def __post_init__(self):
        if self.convolution < 1:
            raise ValueError("the convolution must cover a record at least")
        if self.width < 3:
            raise ValueError("length - convolution must be 3 at least, for three components")
        if self.segments < 1 or self.query < 1 or self.grid < 3 or self.scale <= 0:
            raise ValueError("segments, query, grid and scale must be positive, grid 3 at least")
        if self.chunk and self.chunk < self.reach:
            raise ValueError(f"chunk must be 0 or at least {self.reach}")

    @property
    def width(self) -> int:
        """Columns of the embedding."""
        return self.length - self.convolution

    @property
    def reach(self) -> int:
        """Records after a position that its score can depend on directly."""
        return 2 * self.length + self.query + 2

    def check_length(self, n: int) -> None:
        if n < self.length + 3:
            raise ValueError(f"a series of {n} records is too short for subsequences of {self.length}")

    def chunk_for(self, n: int, parallelism: int) -> int:
        """About two chunks a core, between 4096 records and LARGEST, so that a task's memory doesn't grow with the series."""
        return self.chunk or max(self.reach, 4096, min(LARGEST, -(-n // max(1, 2 * parallelism))))
