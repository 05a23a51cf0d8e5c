"""All tunable values, in one frozen place that is handed to plan builders."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults and word lists that results depend on.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "!", "?", " ", "")
QUESTION_WORDS = ("什么", "怎么", "如何", "为什么", "哪", "谁", "多少", "吗", "呢", "？", "?", "能不能", "可不可以")
PRONOUNS = ("它", "他", "她", "这个", "那个", "这些", "那些", "它的", "他的", "她的", "这", "那", "上面", "前面", "刚才")
FILE_TYPES = ("txt", "pdf", "md", "pptx", "docx")
ARCHIVE_TYPES = (".zip", ".tar.gz")
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
TOOL_LIMITS = (("knowledge_search", 3), ("web_search", 2), ("summarize_document", 2))


@dataclass(frozen=True)
class Params:
    """Settings of retrieval, ingestion and management."""

    final_k: int = 5
    keyword_k: int = 10
    vector_k: int = 10
    distance_threshold: float = 0.45  # 0 turns the cut off
    rrf_constant: int = 60
    k1: float = 1.5
    b: float = 0.75
    idf_floor: float = 0.25
    chunk_size: int = 500
    chunk_overlap: int = 50
    separators: tuple[str, ...] = SEPARATORS
    merge_threshold: float = 0.7
    merge_max_len: int = 1500
    batch_count: int = 50
    batch_chars: int = 18_000
    embed_pause: float = 0.1  # seconds between calls
    embed_waits: tuple[float, ...] = (1.0, 2.0)  # seconds before another try: three tries
    keyword_max_len: int = 10
    rewrite_min_len: int = 3
    history_turns: int = 5
    question_words: tuple[str, ...] = QUESTION_WORDS
    pronouns: tuple[str, ...] = PRONOUNS
    hash_distance: int = 10
    chart_area: int = 5_000
    charts_per_page: int = 5
    contour_area: int = 500
    contour_image_area: int = 5_000
    contour_image_side: int = 50
    image_side: int = 30
    image_prefix: str = "extracted_images/"
    server_url: str = "http://127.0.0.1:8000"
    page_size: int = 20
    title_length: int = 20
    chunk_id_digits: int = 4
    tool_limits: tuple[tuple[str, int], ...] = TOOL_LIMITS
    tool_limit_default: int = 3
    rerank_chars: int = 512
    max_file_bytes: int = 100 << 20
    max_archive_bytes: int = 50 << 20
    max_expanded_bytes: int = 200 << 20
    idle_seconds: int = 600
    queue_size: int = 256  # events that wait for a reader
    file_types: tuple[str, ...] = FILE_TYPES
    encodings: tuple[str, ...] = ENCODINGS
    clean_text: bool = True


DEFAULT = Params()
