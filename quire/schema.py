"""Schemas of the tables that documents are turned into.

Missing strings are empty, not null, and order is a column everywhere: tables have no order of their own.
"""

from __future__ import annotations

CELL = "struct<text:string,html:string,colspan:int,rowspan:int>"
GRID = f"array<array<{CELL}>>"
RAW_RUN = f"struct<text:string,bold:boolean,italic:boolean,superscript:boolean,subscript:boolean,char_style:string,font:string,point_size:double,image_uri:string,textframe_story:string,grid:{GRID}>"
RUN = "struct<text:string,bold:boolean,italic:boolean,superscript:boolean,subscript:boolean,char_style:string,is_image:boolean,src:string,original_ref:string,alt:string,tall:boolean,max_h_px:double,latex:string>"

PARTS = "doc_id string, part_name string, body binary"
PARAGRAPHS = f"doc_id string, story_id string, part_name string, para_ix int, para_style string, runs array<{RAW_RUN}>"
#: Page items as they stand in a spread: ``item_ix`` is the order in which frames are listed.
ITEMS = "doc_id string, part_name string, item_ix int, kind string, self_id string, name string, bounds string, transform string, story_id string, column_count int, prev_frame string, next_frame string, link_uri string"
PAGES = "doc_id string, self_id string, name string, page_index int, width double, height double, x_offset double, y_offset double"
FRAMES = "doc_id string, frame_ix int, self_id string, kind string, story_id string, x double, y double, width double, height double, page_index int, page_name string, column_count int, prev_frame string, next_frame string, link_uri string, col int"
PLACEMENTS = "doc_id string, placement_ix int, kind string, page_index int, col int, y double, x double, story_id string, frame_ix int, self_id string, width double, height double, link_uri string"
BLOCKS = (
    "doc_id string, order_key int, block_kind string, type string, page int, col int, x double, y double, story_id string, frame_id string, "
    f"box_group int, box_kind string, anchored boolean, ex_label boolean, runs array<{RUN}>, text string, src string, original_ref string, alt string, "
    f"width double, height double, latex string, display boolean, fallback_image string, grid {GRID}"
)
EQUATIONS = "basename string, latex string, display boolean"
LINKS = "doc_id string, name string, path string"
PDF_BLOCKS = "doc_id string, page int, block_ix int, x0 double, y0 double, x1 double, y1 double, text string"
VISUALS = "doc_id string, visual_ix int, page int, y0 double, src string, width_px double, height_px double, kind string, anchor_before string, anchor_after string"

BLOCK_TYPES = ("chapter_title", "heading", "subheading", "paragraph", "list_item", "subpoint", "caption", "example", "question", "option", "solution", "math_display", "image", "table", "note")
