"""Options with their defaults, and the constants that the operators share."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

TERM = "[a-z0-9][a-z0-9_-]{2,}"
HEADING_TERMS = "abstract acknowledgments acknowledgements appendix background conclusion conclusions discussion evaluation experiments introduction limitations method methods overview problem references related results".split()
CHECKLIST_PHRASES = [
    "neurips paper checklist", "paper checklist", "question: do the main claims", "answer: [na]", "answer: [yes]", "answer: [no]", "the answer na means", "the answer yes means", "the answer no means",
    "guidelines:", "justification:", "authors should", "authors are encouraged", "the authors are encouraged", "do not remove the checklist", "desk rejected", "at submission time", "genai usage disclosure",
]
CHECKLIST_SECTIONS = ["neurips paper checklist", "genai usage disclosure"]
#: storage name: (display name, keywords)
ROLES = {
    "unknown": ("Unknown", []),
    "front_matter": ("Front matter", ["front matter", "title", "authors", "paper metadata", "paper authors"]),
    "abstract": ("Abstract", ["abstract", "paper abstract", "summary"]),
    "main_body": ("Main body", ["main body", "paper body", "content"]),
    "references": ("References", ["references", "bibliography", "citations"]),
    "appendix": ("Appendix", ["appendix", "supplementary material"]),
    "submission_checklist": ("Submission checklist", ["submission checklist", "paper checklist", "compliance", "guidelines", "disclosure", "neurips", "question", "answer"]),
}
SECTION_PREFIX = "Section:"
LABELS = "caption checkbox_selected checkbox_unselected code document_index footnote formula list_item page_footer page_header paragraph picture chart section_header table text title form key_value_region".split()
TABLE_LIKE, PICTURE_LIKE = ("table", "document_index"), ("picture", "chart")
TEXT_LIKE = tuple(x for x in LABELS if x not in (*TABLE_LIKE, *PICTURE_LIKE, "form", "key_value_region"))
KEYWORD_LIMIT, CAPTION_LIMIT, CONTEXT_KEYWORD_LIMIT = 32, 8, 64


@dataclass(frozen=True)
class ChunkOptions:
    max_chars: int = 1800
    overlap_chars: int = 250
    min_chars: int = 20


@dataclass(frozen=True)
class TfidfOptions:
    text_weight: float = 1.0
    keyword_weight: float = 3.0

    def sane(self) -> TfidfOptions:
        return TfidfOptions(max(0.0, self.text_weight), max(0.0, self.keyword_weight))


@dataclass(frozen=True)
class SearchOptions:
    max_results: int = 6
    candidate_limit: int = 128
    dense_weight: float = 1.0
    lexical_weight: float = 0.15
    use_lexical_filter: bool = True
    use_rrf: bool = True
    fusion_k: int = 60


@dataclass(frozen=True)
class KeywordOptions:
    """``generator`` takes a list of passages (dicts) and gives a list of (source_id, index, keywords)."""

    batch_size: int = 4
    max_parallel: int = 2
    replace_existing: bool = False
    max_keywords: int = 16
    generator: Callable | None = None

    def sane(self) -> KeywordOptions:
        return replace(self, batch_size=max(1, self.batch_size), max_parallel=max(1, self.max_parallel), max_keywords=max(1, self.max_keywords))


def positive_env(name: str) -> int | None:
    """A positive whole number from the environment, or None."""
    try:
        value = int(os.environ.get(name, ""))
    except ValueError:
        return None
    return value if value > 0 else None


@dataclass(frozen=True)
class IndexingOptions:
    batch_size: int = 16
    parallelism: int = field(default_factory=lambda: positive_env("LUMENPASS_INDEX_PARALLELISM") or positive_env("LUMENPASS_MODEL_REPLICAS") or min(3, os.cpu_count() or 1))

    def sane(self) -> IndexingOptions:
        return IndexingOptions(max(1, self.batch_size), max(1, self.parallelism))


@dataclass(frozen=True)
class RuntimeOptions:
    intra_threads: int = 1
    inter_threads: int = 1


@dataclass(frozen=True)
class PdfOptions:
    include_image_notes: bool = True
    filter_numeric_blocks: bool = True


@dataclass(frozen=True)
class ConversionOptions:
    cell_overlap: float = 0.3
    include_empty_text: bool = False
    max_figure_classes: int = 5

    def sane(self) -> ConversionOptions:
        return replace(self, cell_overlap=min(1.0, max(0.0, self.cell_overlap)), max_figure_classes=max(0, self.max_figure_classes))


@dataclass(frozen=True)
class EncoderConfig:
    query_length: int = 48
    document_length: int = 512
    embedding_dim: int = 64
    pad_id: int = 50284
    mask_id: int = 50284
    cls_id: int = 50281
    sep_id: int = 50282
    query_prefix_id: int = 50368
    document_prefix_id: int = 50369
    lower_case: bool = True
    normalize: bool = True
    skip_words: tuple[str, ...] = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass(frozen=True)
class PassageSource:
    id: str
    display_name: str
    location: str
