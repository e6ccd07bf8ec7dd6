"""Schemas of the tables, as Spark DDL."""

SOURCES = "id string, display_name string, location string, text string, enabled boolean"
SOURCES_PRECHUNKED = "id string, display_name string, location string, chunks array<string>, enabled boolean"
PASSAGE_FIELDS = (
    "source_id string, source_display_name string, source_location string, `index` int, text string, section_path array<string>, content_role string, "
    "page_numbers array<int>, layout_labels array<string>, captions array<string>, keywords array<string>"
)
PASSAGES = PASSAGE_FIELDS
PASSAGE_COLUMNS = ["source_id", "source_display_name", "source_location", "index", "text", "section_path", "content_role", "page_numbers", "layout_labels", "captions", "keywords"]
KEYWORD_RESULTS = "source_id string, passage_index int, keywords array<string>"
MULTI_VECTOR = "token_ids array<int>, vectors array<float>, token_count int, embedding_dim int"
BBOX = "struct<l: double, t: double, r: double, b: double, coord_origin: string>"
CELL = f"struct<text: string, bbox: {BBOX}, confidence: double>"
CLUSTER = f"struct<id: int, label: string, confidence: double, bbox: {BBOX}, cells: array<{CELL}>>"
PROV = f"struct<page_no: int, bbox: {BBOX}, char_span: struct<start: int, end: int>>"
COMMON_ITEM = f"self_ref: string, parent: string, label: string, content_layer: string, prov: array<{PROV}>, keywords: array<string>, source_id: string, source_display_name: string"
TABLE_CELL = f"struct<text: string, bbox: {BBOX}, start_row_offset_idx: int, end_row_offset_idx: int, start_col_offset_idx: int, end_col_offset_idx: int, row_header: boolean, column_header: boolean, row_section: boolean>"
TABLE_ITEM = f"struct<{COMMON_ITEM}, data: struct<num_rows: int, num_cols: int, table_cells: array<{TABLE_CELL}>>>"
DOCUMENT_FIELDS = (
    "name: string, origin_file_name: string, origin_mime_type: string, pages: map<int, struct<page_no: int, size: struct<width: double, height: double>>>, "
    f"texts: array<struct<{COMMON_ITEM}, text: string, orig: string>>, "
    f"tables: array<{TABLE_ITEM}>, "
    f"pictures: array<struct<{COMMON_ITEM}, classifications: array<struct<class_name: string, confidence: double>>>>, "
    "body_children: array<string>, furniture_children: array<string>"
)
DOCUMENT = f"struct<{DOCUMENT_FIELDS}>"
BLOCK = "struct<text: string, section_path: array<string>, content_role: string, page_numbers: array<int>, layout_labels: array<string>, captions: array<string>, keywords: array<string>>"
SECTION = "struct<heading: string, blocks: array<string>>"
