"""Every constant of the layout rules in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    safe_top: float = 0.05
    safe_bottom: float = 0.95
    cid_min_length: int = 10
    cid_clean_share: float = 0.6
    heading_sd: float = 1.3
    heading_min_sd: float = 0.5
    heading_mode: float = 1.15
    line_glue: float = 0.3
    slice_gap: float = 1.3
    block_gap: float = 0.5
    block_size: float = 1.5
    merge_gap: float = 0.8
    space_line: float = 0.4
    space_gap: float = 0.16
    gutter_width: float = 2.0
    blur: int = 2
    narrow: float = 0.6
    watermark_share: float = 0.85
    watermark_glyphs: int = 20
    vector_margin: float = 15.0
    merge_margin: float = 5.0
    significant: float = 50.0
    zone_share: float = 0.8
    zone_pages: int = 3
    zone_length: int = 100
    doc_heading_sd: float = 1.5
    doc_heading_default: float = 14.0
    stack_tolerance: float = 0.5
    anchor_margin: float = 60.0
    link_margin: float = 60.0
    link_overlap: float = 15.0
    link_tolerance: float = 20.0
    node_text: int = 5000


DEFAULT = Layout()
PAGE = ["doc_id", "page_number"]
