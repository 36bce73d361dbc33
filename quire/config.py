"""Settings with the defaults the reference ships, clamped the same way."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values that must equal the reference's for equal results ---------
SENSITIVE_KEY_PATTERNS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "credential",
)
DEFAULT_IGNORE_PATTERNS = (
    "node_modules/**", "build/**", ".git/**", "coverage/**",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
)
DEFAULT_BINARY_PATTERNS = (
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.bmp", "*.svg", "*.mp3",
    "*.mp4", "*.wav", "*.avi", "*.mov", "*.zip", "*.tar", "*.gz", "*.exe", "*.dll",
    "*.so", "*.dylib", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.bin", "*.dat",
)
SECTION_SEPARATOR = "// ═══════════════════════════════════════"
TREE_VERTICAL, TREE_HORIZONTAL, TREE_BRANCH, TREE_CORNER = "│", "─", "├", "└"
FILE_EMOJI, FOLDER_EMOJI, WARNING_EMOJI, BINARY_EMOJI = "📄", "📁", "⚠️", "🖼️"
CHARS_PER_TOKEN = 3.75
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    max_file_size: int = 51200
    max_tokens: int = 128000
    text_preview_length: int = 300
    log_sample_lines: int = 5
    csv_sample_rows: int = 3
    default_template: str = "default"
    sensitive_key_patterns: tuple = SENSITIVE_KEY_PATTERNS
    auto_detect_language: bool = True
    ignore_patterns: tuple = DEFAULT_IGNORE_PATTERNS
    binary_file_patterns: tuple = DEFAULT_BINARY_PATTERNS
    ignore_file_name: str = ".contextignore"
    show_tree_emoji: bool = True
    token_estimation: str = "tiktoken"
    outline_detail: str = "standard"
    outline_include_private: bool = False
    outline_extract_comments: bool = True
    outline_max_items: int = 50
    enable_large_file_degradation: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    def clamped(self) -> "Config":
        """Clamp numeric settings to their valid ranges; 0 stands for the default
        where a size cannot be 0."""
        return replace(
            self,
            max_file_size=max(1, int(self.max_file_size or Config.max_file_size)),
            max_tokens=max(1, int(self.max_tokens or Config.max_tokens)),
            text_preview_length=max(1, int(self.text_preview_length or Config.text_preview_length)),
            log_sample_lines=max(0, int(self.log_sample_lines or 0)),
            csv_sample_rows=max(0, int(self.csv_sample_rows or 0)),
            outline_max_items=min(200, max(10, int(self.outline_max_items or Config.outline_max_items))),
            outline_detail=self.outline_detail
            if self.outline_detail in ("basic", "standard", "detailed") else "standard",
        )


DEFAULT = Config()
