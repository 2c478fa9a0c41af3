"""Table schemas and the key that says whether stored tables still fit the code."""

from __future__ import annotations

import hashlib
from pathlib import Path

FILES = "path string, language string, content_hash string, mtime timestamp, size bigint"
SYMBOLS = (
    "id string, name string, kind string, signature string, language string, file string, line_start int, line_end int, "
    "byte_start int, byte_end int, container string, owner string, doc string"
)
EDGES = (
    "edge_id string, kind string, from_id string, to_name string, to_id string, confidence string, qualifier string, alternatives int, line int"
)
KINDS = ["module", "function", "method", "class", "struct", "enum", "trait", "interface", "type", "constant", "import", "field"]
EDGE_KINDS = ["calls", "references", "imports", "contains", "defines"]
CALLABLE = ["function", "method"]
CONFIDENCE = ["precise", "heuristic"]
#: File extensions by language.
EXTENSIONS = {
    "rust": ["rs"], "python": ["py", "pyi"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "go": ["go"],
    "java": ["java"], "c": ["c"], "cpp": ["cc", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx"], "csharp": ["cs"], "ruby": ["rb", "rake"],
}
DEFAULT_BUDGET, DEFAULT_DEPTH = 4000, 3


def schema_key() -> str:
    """Digest of the schemas and the extraction rules (X3): stored tables of another key are dropped."""
    rules = Path(__file__).with_name("extract.py")
    return hashlib.md5((FILES + SYMBOLS + EDGES).encode() + (rules.read_bytes() if rules.exists() else b"")).hexdigest()
