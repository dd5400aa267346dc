"""Parameters of an extraction, with their defaults (fixed values: they decide results)."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    repeat_ratio: float = 0.3
    size_tol: float = 0.6
    tiny_ratio: float = 0.5
    col_tol: float = 12.0
    line_gap: float = 2.2
    join_gap: float = 1.2
    min_len: int = 2
    body_size: float | None = None
    section_min_pt: float | None = None
    section_max_len: int = 40
    min_repeat_pages: int = 5
    col_gap_ratio: float = 0.06
    terminator: str = "。"
    auto_join: bool = True
    order: str = "reading"
    table_strategy: str = "lines_strict"

    @classmethod
    def of(cls, settings: dict) -> Params:
        """Unknown keys are dropped; an unknown table strategy falls back to the default."""
        known = {f.name for f in fields(cls)}
        kept = {k: v for k, v in settings.items() if k in known}
        if kept.get("table_strategy") not in (None, "lines_strict", "lines", "text", "none"):
            del kept["table_strategy"]
        if "auto_join" in kept:
            kept["auto_join"] = bool(kept["auto_join"])
        return cls(**kept)


#: Keywords of a list that is absent or empty.
KEYWORDS = ["生成AI", "生成 AI", "生成系AI", "ジェネレーティブAI", "ジェネレーティブ AI", "Generative AI", "GenAI", "Gen AI", "大規模言語モデル", "LLM", "ChatGPT"]
KINDS = ["body", "large", "small", "tiny", "table"]
