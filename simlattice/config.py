"""Detector configuration: thresholds and language profiles.

Configuration is immutable. ``with_patterns`` / ``with_profile`` return new
objects; nothing is shared or mutated between detectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds and hash parameters. The defaults are fixed values of the contract."""

    high_confidence_threshold: float = 0.80
    medium_confidence_threshold: float = 0.60
    plagiarism_threshold: float = 0.60
    hash_bits: int = 256
    shingle_sizes: tuple[int, int, int] = (2, 3, 4)
    shingle_thresholds: tuple[int, int] = (5, 15)

    def __post_init__(self):
        if self.hash_bits <= 0 or self.hash_bits % 8 != 0:
            raise ValueError("hash_bits must be a positive number of whole bytes")

    @property
    def hash_bytes(self) -> int:
        return self.hash_bits // 8

    @property
    def hash_words(self) -> int:
        return -(-self.hash_bits // 64)


@dataclass(frozen=True)
class LanguageProfile:
    """What counts as structure for one language.

    ``lexer`` picks how text becomes a node stream: ``python`` (indentation),
    ``brace`` (java/cpp family), ``html`` (tags) or ``text`` (words).
    ``else_counts`` is the per-language plain-``else`` rule: True when nodes
    inside a plain else block sit one level deeper than the ``if`` (java), False
    when the else block is transparent (python, cpp).
    """

    name: str
    lexer: str
    extensions: tuple[str, ...]
    structural_nodes: tuple[str, ...]
    pattern_mappings: Mapping[str, tuple[str, ...]]
    else_counts: bool = False
    keyword_nodes: Mapping[str, str] = field(default_factory=dict)

    def node_to_pattern(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for pattern, nodes in self.pattern_mappings.items():
            for node in nodes:
                out[node] = pattern
        return out

    def with_patterns(self, patterns: Mapping[str, tuple[str, ...] | list[str]]) -> "LanguageProfile":
        merged = dict(self.pattern_mappings)
        for k, v in patterns.items():
            merged[k] = tuple(v)
        return replace(self, pattern_mappings=MappingProxyType(merged))


def _profile(**kw) -> LanguageProfile:
    kw["pattern_mappings"] = MappingProxyType({k: tuple(v) for k, v in kw["pattern_mappings"].items()})
    kw["keyword_nodes"] = MappingProxyType(dict(kw.get("keyword_nodes", {})))
    return LanguageProfile(**kw)


# ---------------------------------------------------------------------------
# Extensions, structural node types and pattern mappings of the
# three source-code languages, as the reference detector defines them.
# ---------------------------------------------------------------------------
PYTHON = _profile(
    name="python", lexer="python", extensions=(".py",),
    structural_nodes=("function_definition", "class_definition", "if_statement",
                      "for_statement", "while_statement", "try_statement",
                      "with_statement", "return_statement", "call"),
    pattern_mappings={"LOOP": ("for_statement", "while_statement"),
                      "COND": ("if_statement",)},
    else_counts=False,
    keyword_nodes={"for": "for_statement", "while": "while_statement", "if": "if_statement",
                   "try": "try_statement", "with": "with_statement",
                   "def": "function_definition", "class": "class_definition",
                   "return": "return_statement", "CALL": "call"},
)
JAVA = _profile(
    name="java", lexer="brace", extensions=(".java",),
    structural_nodes=("method_declaration", "class_declaration", "if_statement",
                      "for_statement", "while_statement", "try_statement",
                      "enhanced_for_statement", "return_statement", "method_invocation"),
    pattern_mappings={"LOOP": ("for_statement", "while_statement", "enhanced_for_statement", "do_statement"),
                      "COND": ("if_statement",)},
    else_counts=True,
    keyword_nodes={"for": "for_statement", "forin": "enhanced_for_statement",
                   "while": "while_statement", "do": "do_statement", "if": "if_statement",
                   "try": "try_statement", "class": "class_declaration",
                   "return": "return_statement", "CALL": "method_invocation"},
)
CPP = _profile(
    name="cpp", lexer="brace", extensions=(".cpp", ".cc", ".cxx", ".c", ".h", ".hpp"),
    structural_nodes=("function_definition", "class_specifier", "if_statement",
                      "for_statement", "while_statement", "try_statement",
                      "return_statement", "call_expression"),
    pattern_mappings={"LOOP": ("for_statement", "while_statement", "for_range_loop", "do_statement"),
                      "COND": ("if_statement",)},
    else_counts=False,
    keyword_nodes={"for": "for_statement", "forin": "for_range_loop",
                   "while": "while_statement", "do": "do_statement", "if": "if_statement",
                   "try": "try_statement", "class": "class_specifier",
                   "return": "return_statement", "CALL": "call_expression"},
)

# Extension -> language tables of the three load paths.
# Strict / per-file detection (knows .cxx):
DETECT_EXTENSIONS = {".py": "python", ".java": "java", ".cpp": "cpp", ".cc": "cpp",
                     ".cxx": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp"}
# Upload path: same table, unknown extensions default to python.
UPLOAD_EXTENSIONS = dict(DETECT_EXTENSIONS)
UPLOAD_DEFAULT_LANGUAGE = "python"
# Bank scan: no .cxx; unknown extensions are skipped silently.
BANK_EXTENSIONS = {".py": "python", ".java": "java", ".cpp": "cpp", ".cc": "cpp",
                   ".c": "cpp", ".h": "cpp", ".hpp": "cpp"}
# Upload widgets accept these (case-insensitive); the manager's file count
# compares suffixes case-sensitively against the same list.
UPLOAD_ALLOWED = (".py", ".java", ".cpp", ".cc", ".c", ".h", ".hpp")

# Preview lengths (compare view, browse, search hit, add form),
# result limits and the search-badge cut points.
PREVIEW_COMPARE, PREVIEW_BROWSE, PREVIEW_SEARCH, PREVIEW_ADD = 3000, 2000, 800, 500
BROWSE_LIMIT = 50
SEARCH_LIMIT = 100
#: Hashes of unlike structure differ in about half of their bits, so this finds what lower syntactic thresholds mean.
SYNTACTIC_T = 0.97
SHOWN_HITS = 10
MATRIX_MAX_FILES = 20
MATRIX_NAME_CHARS = 20
BADGE_HIGH, BADGE_MEDIUM = 0.80, 0.60
BEST_HIGH, BEST_MEDIUM = 0.90, 0.75   # hard-coded best-score confidence cuts

# ---------------------------------------------------------------------------
# Engine profiles for the non-code tables (our own choice, not the reference's).
# html: tag tree; repeating containers are loops, paragraphs and navigation are
# conditional blocks. text: every word is a node at depth 0.
# ---------------------------------------------------------------------------
HTML_VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input",
                  "link", "meta", "param", "source", "track", "wbr")
HTML = _profile(
    name="html", lexer="html", extensions=(".html", ".htm"),
    structural_nodes=("html", "head", "body", "nav", "header", "footer", "main",
                      "article", "section", "aside", "div", "ul", "ol", "li",
                      "table", "tr", "td", "form", "h1", "h2", "h3", "p"),
    pattern_mappings={"LOOP": ("ul", "ol", "table"), "COND": ("p", "nav")},
)
TEXT = _profile(
    name="text", lexer="text", extensions=(".txt",),
    structural_nodes=(), pattern_mappings={},
)

DEFAULT_PROFILES: Mapping[str, LanguageProfile] = MappingProxyType(
    {p.name: p for p in (PYTHON, JAVA, CPP, HTML, TEXT)})


def register_profile(profiles: Mapping[str, LanguageProfile], profile: LanguageProfile) -> dict[str, LanguageProfile]:
    """Return a new profile table with ``profile`` added or replaced."""
    if profile.lexer not in ("python", "brace", "html", "text"):
        raise ValueError(f"no such lexer: {profile.lexer}")
    out = dict(profiles)
    out[profile.name] = profile
    return out


def update_patterns(profiles: Mapping[str, LanguageProfile], language: str,
                    patterns: Mapping[str, tuple[str, ...] | list[str]]) -> dict[str, LanguageProfile]:
    """Return a new profile table where ``language`` has extra/overwritten mappings."""
    if language not in profiles:
        raise ValueError(f"no profile named {language}")
    out = dict(profiles)
    out[language] = profiles[language].with_patterns(patterns)
    return out


def lang_ext_frame(spark: SparkSession, profiles: Mapping[str, LanguageProfile] = DEFAULT_PROFILES) -> DataFrame:
    rows = [(p.name, e) for p in profiles.values() for e in p.extensions]
    return spark.createDataFrame(rows, "language string, ext string")


def lang_node_frame(spark: SparkSession, profiles: Mapping[str, LanguageProfile] = DEFAULT_PROFILES) -> DataFrame:
    rows = []
    for p in profiles.values():
        n2p = p.node_to_pattern()
        nodes = list(dict.fromkeys(list(p.structural_nodes) + list(n2p)))
        for n in nodes:
            rows.append((p.name, n, n in p.structural_nodes, n in ("else_clause",), n2p.get(n)))
    return spark.createDataFrame(
        rows, "language string, node_type string, is_structural boolean, is_passthrough boolean, pattern string")
