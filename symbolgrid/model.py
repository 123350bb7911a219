"""Code tables, table schemas and settings of the symbol store."""

from __future__ import annotations

from dataclasses import dataclass

#: Symbol kinds.
VARIABLE, FUNCTION, CLASS, INTERFACE, TYPE_ALIAS, ENUM, NAMESPACE, MODULE, METHOD, PROPERTY = range(10)
#: Symbol flags.
DEFAULT_EXPORT, TYPE_ONLY, RE_EXPORT, INNER_CLASS, MODULE_IMPORT, STANDARD_LIBRARY = 1, 2, 4, 16, 32, 64
#: File extensions of the languages.
EXTENSIONS = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi"),
    "java": ("java",),
}
#: Languages that can import from each other.
GROUPS = {"typescript": "web", "javascript": "web", "python": "python", "java": "java"}
#: Globs that a scan leaves out by default.
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/target/**",
    "**/build/**", "**/dist/**", "**/out/**", "**/.git/**",
)
MAX_FILE_BYTES = 1 << 20
SCHEMA_VERSION = 2

SYMBOL = "name string, kind int, flags int, parent_qualifier string, source_path string, line int, col int"
FILES = "path string, lang string, lang_group string, file_qualifier string, content_hash string, mtime long, n_exports int, status string"
EXPORTS = f"path string, ord int, {SYMBOL}, file_qualifier string"
RE_EXPORT_NAMES = "array<struct<exported_name:string,source_name:string>>"
RE_EXPORTS = f"path string, ord int, from_path string, names {RE_EXPORT_NAMES}, is_type_only boolean"
EXTRACTED = (
    "path string, lang string, content_hash string, mtime long, status string, file_qualifier string, "
    "exports array<struct<name:string,kind:int,flags:int,parent_qualifier:string,line:int,col:int>>, "
    f"re_exports array<struct<from_path:string,names:{RE_EXPORT_NAMES},is_type_only:boolean>>"
)
WORDS = "name string, name_lc string, bucket string, initials string"
PACKAGES = "folder string, name string"
ALIASES = "config string, ord int, pattern string, target string"
QUERIES = (
    "query_id long, prefix string, current_path string, language string, `limit` int, "
    "already_imported array<string>, line_prefix string, line_suffix string"
)
SUGGESTIONS = (
    "query_id long, position int, name string, kind int, flags int, target_path string, "
    "file_qualifier string, parent_qualifier string, score int"
)


@dataclass(frozen=True)
class Settings:
    """What a store is built from. Its fingerprint is part of a snapshot: other settings, other store."""

    root: str
    languages: tuple[str, ...] = ("typescript", "javascript", "python", "java")
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    respect_all: bool = True
    include_inner: bool = True
    script_packages: bool = True
    python_packages: bool = True
    extra_paths: tuple[str, ...] = ()
    package_depth: int = 3
    standard_library: bool = True
    runtime_library: bool = False
    min_prefix: int = 1
    type_imports: str = "auto"

    def fingerprint(self) -> str:
        import hashlib

        shape = (SCHEMA_VERSION, self.languages, self.exclude, self.respect_all, self.include_inner, self.script_packages, self.python_packages,
                 self.extra_paths, self.package_depth, self.standard_library, self.runtime_library)
        return hashlib.sha256(repr(shape).encode()).hexdigest()[:16]
