"""Parameters shared by the stages of the sequence pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Sketch and alignment parameters; `compat` also reproduces the counting quirks of the original programs."""

    w: int = 80
    k: int = 56
    r: int = 6
    tol: float = 0.01
    min_ec_cov: int = 1
    bestn: int = 6
    min_read_len: int = 500
    max_postings: int = 12_000
    gap: int = 24
    min_hits: int = 3
    max_tries: int = 321
    compat: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.k <= 56:
            raise ValueError("k must be from 1 to 56")
        if not 0 < self.w <= 128:
            raise ValueError("w must be from 1 to 128")
        if not 0 < self.r < 13:
            raise ValueError("r must be from 1 to 12")


#: Parameters for documents mapped to four letters (an odd k, so no k-mer is its own reverse complement).
TEXT_PARAMS = Params(w=16, k=31, r=3)
