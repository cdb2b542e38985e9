"""Configuration of a skimming run."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from gistmill.functions import vocab


@dataclass(frozen=True)
class SkimConfig:
    """Typed settings; `from_session` overrides them by spark.conf gistmill.<name>."""

    provider: str = "openai-compatible"
    model: str = ""
    label_mode: str = "default"
    custom_labels: str = ""
    hidden_labels: str = "[]"
    view: str = "core"
    context_tokens: int = 8192
    annotation_destination: str = "comment"
    annotation_prefix: bool = False
    summaries: bool = True
    consent: bool = False
    chunk_budget: int | None = None

    @classmethod
    def from_session(cls, spark: SparkSession) -> SkimConfig:
        out = cls()
        for f in fields(cls):
            value = spark.conf.get(f"gistmill.{f.name}", None)
            if value is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: value == "true" if kind is bool else int(value) if f.name in ("context_tokens", "chunk_budget") else value})
        return out

    @property
    def context_limit(self) -> int:
        return max(2048, self.context_tokens or 8192)

    @property
    def selection_budget(self) -> int:
        """Tokens for sentences in one request, less the reserve for prompt and reply."""
        limit = self.context_limit
        return self.chunk_budget or max(1024, limit - min(vocab.RESERVE_TOKENS, limit * 2 // 5))

    @property
    def model_name(self) -> str:
        return self.model.strip()
