"""Schemas of the entities that the operators exchange."""

CHUNK = """chunk_id string, title string, content string, breadcrumbs array<string>, section_level int, section_path string,
content_type string, version string, module string, param_name string, ui_path string, error_code string, source_url string,
source_format string, page_range array<int>, anchor string, lang string, hash string, updated_at timestamp_ntz,
parent_chunk_id string, child_chunk_ids array<string>, image_ids array<string>"""
FIGURE = "struct<src:string,alt:string,caption:string,type:string>"
SECTION = f"page_id long, section_id string, title string, content string, level int, anchor string, tables array<string>, figures array<{FIGURE}>"
SPAN = "doc_id string, page int, block int, line int, span int, font string, size double, flags int, text string"
IMAGE = "id string, chunk_id string, source_url string, page_number int, index_in_page int, width int, height int, file_size_bytes long, caption string, ocr_text string, hash string"
RESULT = "query_id long, chunk_id string, score double, rank int"
CONTENT_TYPES = ("procedure", "parameter", "concept", "faq", "error", "table", "figure")
QUERY_TYPES = ("parameter", "procedure", "error", "general")
