"""Pluggable services. The defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    """Reads a file's bytes: pages gives (page, text), images (page, image, extension, bytes); a document reader fits here."""

    def pages(self, content: bytes) -> list[tuple[int, str]]: ...

    def images(self, content: bytes) -> list[tuple[int, int, str, bytes]]: ...


class Recogniser(Protocol):
    """The text of an image's bytes; an OCR engine fits here."""

    def text(self, content: bytes) -> str: ...


class LanguageModel(Protocol):
    def complete(self, system: str, user: str, max_tokens: int) -> str: ...


class HashingEmbedder:
    """Counts of hashed character trigrams, with unit length; of a text without any, zeros."""

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            t = f" {(text or '').lower()} "
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class SilentModel:
    """Answers nothing, so that the fallbacks are used."""

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        return ""


@dataclass
class ChatService:
    """A chat endpoint over HTTP. style "messages" sends max_tokens and reads choices, "local" sends options and reads message."""

    url: str
    model: str
    style: str = "local"
    api_key: str = ""
    timeout: float = 300.0

    def _sent(self, url: str, body: dict | None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(url, None if body is None else json.dumps(body, ensure_ascii=False).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.loads(reply.read().decode("utf-8", "replace"))

    def complete(self, system: str, user: str, max_tokens: int) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if self.style == "messages":
            reply = self._sent(self.url, body | {"temperature": 0.0})
            return ((reply.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        reply = self._sent(self.url, body | {"stream": False, "options": {"temperature": 0.0, "num_predict": max_tokens}})
        return (reply.get("message") or {}).get("content") or ""

    def models(self, url: str) -> list[str]:
        """The names that a local service lists."""
        listed = self._sent(url, None).get("models")
        names = [str(m.get("name") or m.get("model") or "").strip() for m in listed if isinstance(m, dict)] if isinstance(listed, list) else []
        return [n for n in names if n]


# Models that are chosen where none is asked for, in order.
PREFERRED_MODELS = ["qwen2:7b", "llama3.1:8b", "qwen2", "llama3.1"]


def chosen_model(available: list[str], asked: str = "", scan: bool = True) -> str:
    """The model asked for, which has to be there; else the first preferred one, else the first of all."""
    asked = asked.strip()
    if asked and asked not in available:
        raise ValueError(f"no model {asked}; there are: {', '.join(available) or 'none'}")
    if asked:
        return asked
    if not scan:
        raise ValueError("no model is asked for")
    if not available:
        raise ValueError("there are no models")
    return next((m for m in PREFERRED_MODELS if m in available), available[0])


def embedded(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """Unit vectors of a text column; the model is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = [v for at in range(0, len(s), batch) for v in embedder.encode(s.iloc[at : at + batch].fillna("").tolist())]
            yield pd.Series(rows, index=s.index, dtype=object)

    return run(text)
