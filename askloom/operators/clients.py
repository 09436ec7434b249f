"""Model clients: an offline one that is deterministic, and two that speak HTTP."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

LOCAL_URL, ONLINE_URL = "http://localhost:11434/v1", "https://api.openai.com/v1"
GEMINI_URL = "https://generativelanguage.googleapis.com/v1beta"


class NotAsked(Exception):
    """For clients to raise where the model was not asked, as for want of quota: the chunk stays open for another run."""


@dataclass(frozen=True)
class Reply:
    content: str
    model: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    latency_seconds: float = 0.0
    raw: dict[str, Any] = field(default_factory=dict, repr=False)  # what the server said

    @property
    def total_tokens(self) -> int:
        return self.prompt_tokens + self.completion_tokens

    @property
    def tokens_per_second(self) -> float:
        return self.completion_tokens / self.latency_seconds if self.latency_seconds > 0 and self.completion_tokens > 0 else 0.0


class Client(Protocol):
    """What a model stage needs; a client is sent to the workers by pickle, so it holds settings, not connections.

    settings (temperature, max_tokens) hold for one call in place of the client's own.
    """

    def complete(self, prompt: str, **settings: Any) -> Reply: ...


@dataclass(frozen=True)
class OfflineClient:
    """Numbered pairs about the digest of the prompt's last part (after the last line of three dashes)."""

    pairs: int = 2
    model: str = "offline"
    latency_seconds: float = 0.1

    def complete(self, prompt: str, **settings: Any) -> Reply:
        digest = hashlib.md5(prompt.rpartition("\n---\n")[2].encode()).hexdigest()
        content = "\n".join(f"Q{i}: What is part {i} of the digest?\nA{i}: Part {i} is {digest[8 * i - 8 : 8 * i]}." for i in range(1, self.pairs + 1))
        return Reply(content, self.model, len(prompt.split()), len(content.split()), self.latency_seconds)


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return json.load(got)


@dataclass(frozen=True)
class ChatClient:
    """Any server with a chat completions endpoint. The key is read on the worker from key_variable, or given."""

    model: str = "gpt-4o"
    base_url: str = ONLINE_URL
    api_key: str | None = None
    key_variable: str = "OPENAI_API_KEY"
    temperature: float = 0.3
    max_tokens: int = 1024
    timeout: float = 120.0

    def complete(self, prompt: str, **settings: Any) -> Reply:
        key = self.api_key or os.environ.get(self.key_variable) or ""
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": settings.get("temperature", self.temperature), "max_tokens": settings.get("max_tokens", self.max_tokens)}
        began = time.perf_counter()
        got = _post(f"{self.base_url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout)
        usage = got.get("usage") or {}
        return Reply(got["choices"][0]["message"].get("content") or "", got.get("model", self.model), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), time.perf_counter() - began, got)

    def __repr__(self) -> str:
        return f"ChatClient(model={self.model!r}, base_url={self.base_url!r})"


@dataclass(frozen=True)
class GeminiClient:
    """Gemini's generateContent endpoint; it counts no tokens."""

    model: str = "gemini-1.5-flash"
    api_key: str | None = None
    key_variable: str = "GEMINI_API_KEY"
    temperature: float = 0.3
    max_tokens: int = 1024
    timeout: float = 120.0
    base_url: str = GEMINI_URL

    def complete(self, prompt: str, **settings: Any) -> Reply:
        key = self.api_key or os.environ.get(self.key_variable) or ""
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": settings.get("temperature", self.temperature), "maxOutputTokens": settings.get("max_tokens", self.max_tokens)}}
        began = time.perf_counter()
        got = _post(f"{self.base_url}/models/{self.model}:generateContent", body, {"x-goog-api-key": key}, self.timeout)
        parts = got["candidates"][0].get("content", {}).get("parts", [])
        return Reply("".join(p.get("text", "") for p in parts), self.model, latency_seconds=time.perf_counter() - began, raw=got)

    def __repr__(self) -> str:
        return f"GeminiClient(model={self.model!r})"


def create_client(mode: str = "online", provider: str = "openai", model: str | None = None, api_key: str | None = None, base_url: str | None = None, temperature: float = 0.3, max_tokens: int = 1024, timeout: float = 120.0) -> ChatClient | GeminiClient:
    """The client for a provider (openai, gemini, ollama); the offline mode is a local server. A missing key raises here."""
    provider = {"google gemini": "gemini"}.get(provider.strip().lower(), provider.strip().lower())
    common = {"temperature": temperature, "max_tokens": max_tokens, "timeout": timeout}
    if mode not in ("online", "offline"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "offline" or provider == "ollama":
        return ChatClient(model or "llama3", base_url or LOCAL_URL, api_key, key_variable="", **common)
    if provider == "gemini":
        client = GeminiClient(api_key=api_key, **common)
    elif provider == "openai":
        client = ChatClient(base_url=base_url or ONLINE_URL, api_key=api_key, **common)
    else:
        raise ValueError(f"unknown provider {provider!r}")
    if not api_key and not os.environ.get(client.key_variable):
        raise ValueError(f"no API key: pass one or set {client.key_variable}")
    return replace(client, model=model) if model else client
