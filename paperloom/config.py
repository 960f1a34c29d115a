"""Plain settings of the operators; none of them is a Spark setting."""

from __future__ import annotations

import hmac
import os
from collections.abc import Mapping
from dataclasses import dataclass

from paperloom.errors import ConfigurationError


@dataclass(frozen=True)
class ChunkConfig:
    """Token budgets of chunks."""

    target: int = 400
    maximum: int = 520
    overlap: int = 80
    minimum: int = 80


@dataclass(frozen=True)
class RetrievalProfile:
    """The deployed retrieval pipeline: candidates, results, reranker."""

    name: str = "reranked"
    top_k: int = 20
    top_n: int = 8
    reranker: str = "lexical"
    allow_overrides: bool = False

    def resolve(self, top_k: int | None = None, top_n: int | None = None, use_reranker: bool | None = None) -> tuple[int, int, bool]:
        """Effective values: overrides count only where allowed, and 0 or None mean the default."""
        if not self.allow_overrides:
            top_k = top_n = use_reranker = None
        enabled = self.reranker.strip().lower() not in ("", "none", "off", "false")
        return top_k or self.top_k, top_n or self.top_n, enabled if use_reranker is None else use_reranker


def env_bool(name: str, default: bool = False) -> bool:
    """1, true, yes and on are true, in any case; blank means the default."""
    v = os.environ.get(name, "").strip().lower()
    return v in ("1", "true", "yes", "on") if v else default


def env_number(name: str, default: float, kind: type = int) -> float:
    """A number from the environment; blank means the default."""
    v = os.environ.get(name, "").strip()
    return kind(v) if v else default


@dataclass(frozen=True)
class Settings:
    """What a deployment sets in its environment; blank values count as absent."""

    embedding_provider: str = "hash"
    embedding_model: str = ""
    llm_provider: str = "mock"
    llm_model: str = ""
    compatible_model: str = ""
    llm_temperature: float = 0.1
    llm_max_tokens: int = 900
    reranker: str = "none"
    reranker_model: str = ""
    backend_api_key: str = ""
    retrieval_top_k: int = 20
    rerank_top_n: int = 8
    keys: Mapping[str, str] | None = None

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> "Settings":
        """From environment variables; numbers that are none are a configuration error."""
        env = os.environ if env is None else env
        get = lambda name, default="": env.get(name, "").strip() or default

        def number(name: str, default: float, kind: type) -> float:
            try:
                return kind(get(name, str(default)))
            except ValueError:
                raise ConfigurationError(f"{name} is no number: {env[name]!r}") from None

        return cls(
            get("EMBEDDING_PROVIDER", "hash").lower(), get("EMBEDDING_MODEL"), get("LLM_PROVIDER", "mock").lower(), get("LLM_MODEL_NAME"), get("OPENAI_COMPATIBLE_MODEL"), number("LLM_TEMPERATURE", 0.1, float), number("LLM_MAX_TOKENS", 900, int),
            get("RERANKER_PROVIDER", "none").lower(), get("RERANKER_MODEL"), get("BACKEND_API_KEY"), number("RETRIEVAL_TOP_K", 20, int), number("RERANK_TOP_N", 8, int), {k: v.strip() for k, v in env.items() if k.endswith(("_API_KEY", "_BASE_URL")) and v.strip()},
        )

    @property
    def active_model(self) -> str:
        """The model in use: a compatible server's own name for it, if it has one."""
        return self.compatible_model or self.llm_model if self.llm_provider == "openai_compatible" else self.llm_model

    def key(self, *names: str) -> str:
        """The first of the named keys that is set."""
        found = next((v for n in names if (v := (self.keys or {}).get(n))), None)
        if found is None:
            raise ConfigurationError(f"{' or '.join(names)} is required")
        return found


def api_key_accepted(expected: str | None, given: str | None) -> bool:
    """whether a request may pass: any if no key is set, else only one with the very key."""
    return not expected or given is not None and hmac.compare_digest(expected.encode(), given.encode())
