"""Tunables of the whole library; their defaults are part of its behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_chars: int = 1400
    chunk_overlap: int = 210
    table_max_chars: int = 4000
    dense_k: int = 8
    bm25_k: int = 8
    rrf_k: int = 15
    context_chunks: int = 5
    k1: float = 1.5
    b: float = 0.75
    stem_min: int = 4
    stem_cap: int = 24
    guard_dense_min: float = 0.30
    guard_bm25_min: float = 1.0
    confidence_dense_min: float = 0.15
    confidence_dense_max: float = 0.60
    confidence_bm25_sat: float = 5.0
    confidence_dense_path: float = 92.0
    confidence_bm25_path: float = 64.0
    confidence_bonus: float = 8.0
    confidence_blind_floor: float = 74.0
    confidence_answered_floor: float = 55.0
    header_ratio: float = 0.6
    header_band: float = 0.10
    crop_margin: float = 0.07
    equation_max_lines: int = 5
    equation_symbol_ratio: float = 0.25
    equation_margin: float = 0.15
    image_min_px: float = 100.0
    image_min_side_px: float = 300.0
    image_min_area_ratio: float = 0.15
    ocr_min_confidence: float = 70.0
    ocr_min_alnum: float = 0.75
    ocr_min_words: int = 10
    ocr_min_coverage: float = 0.05
    diagram_max_words: int = 25
    diagram_max_coverage: float = 0.15
    heading_max_chars: int = 120
    heading_ratio: float = 1.15
    heading_stack: int = 3
    page_context_chars: int = 200
    embed_batch: int = 64
    max_file_bytes: int = 25 * 1024 * 1024


DEFAULT = Config()
