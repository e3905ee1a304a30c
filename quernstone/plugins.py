"""Model plug-ins: what an encoder, scorer or language model must offer, and offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Sequence
from typing import Protocol


class Encoder(Protocol):
    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def predict(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> str | None: ...


WORD = re.compile(r"[㐀-鿿]+|[^\W_㐀-鿿]+")


def words(text: str | None) -> list[str]:
    """Words and digits in lower case, and pairs of Chinese characters, as the tokenizer of the library cuts them."""
    out: list[str] = []
    for w in WORD.findall((text or "").lower()):
        out += [w[i : i + 2] for i in range(len(w) - 1)] if "㐀" <= w[0] <= "鿿" and len(w) > 1 else [w]
    return out


class HashedEncoder:
    """A bag of hashed words, scaled to unit length: deterministic and offline."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in words(text):
                d = hashlib.md5(w.encode(), usedforsecurity=False).digest()
                v[int.from_bytes(d[:4], "big") % self.dim] += 1.0 if d[4] & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


class LexicalScorer:
    """Share of the query's words that the passage has."""

    def predict(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            q = set(words(query))
            out.append(len(q & set(words(passage))) / len(q) if q else 0.0)
        return out


class EchoModel:
    """Answers with the context's first sentence: enough to run a pipeline without a network."""

    def complete(self, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> str:
        body = prompt.rsplit("\n\n", 1)[0]
        return body.strip().split("\n")[-1][:200]


class ModelError(RuntimeError):
    pass


class ChatModel:
    """A model behind an HTTP service for chat completions; without a key it cannot be made."""

    def __init__(self, url: str, key: str | None, model: str, timeout: float = 120.0):
        if not key:
            raise ValueError("a key for the service is needed")
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def complete(self, prompt: str, temperature: float = 0.0, max_tokens: int = 512) -> str | None:
        return self._send([{"role": "user", "content": prompt}], temperature, max_tokens)

    def describe(self, data_url: str, prompt: str, system: str = "") -> str | None:
        """A reply about an image."""
        parts = [{"type": "image_url", "image_url": {"url": data_url}}, {"type": "text", "text": prompt}]
        return self._send([*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": parts}], 0.0, None)

    def _send(self, messages: list[dict], temperature: float, max_tokens: int | None) -> str | None:
        body = {"model": self.model, "messages": messages, "temperature": temperature} | ({"max_tokens": max_tokens} if max_tokens else {})
        ask = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]
        except Exception as e:
            raise ModelError(f"model call failed: {e}") from e


def with_retries(call: Callable[[], str], attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call()``, again after 1, 2, 4 ... pauses if it raises; ModelError after the last attempt."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1:
                raise ModelError(str(e)) from e
            sleep(pause * 2**i)
    raise ModelError("no attempt was made")
