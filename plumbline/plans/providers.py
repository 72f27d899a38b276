"""A provider that asks a hosted model over HTTP in the common chat-completions form.

Which model, where and with which key comes from a ModelConfig or the environment
(``providers``); nothing is contacted unless a HostedModel is made and asked. Tests pass their own ``send``.
"""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from .suggest import CodeSuggestion, SuggestionError


class AuthError(SuggestionError):
    """The key is missing, wrong or not allowed to use the model."""


class RateError(SuggestionError):
    """Too many requests in a while; a later try may work."""


class QuotaError(SuggestionError):
    """What was paid for is used up; trying again doesn't help."""


class OverloadError(SuggestionError):
    """The service is overloaded or broken; a later try may work."""


class AnswerError(SuggestionError):
    """The answer was cut off, refused, or isn't a suggestion."""


@dataclass(frozen=True)
class ModelConfig:
    """temperature_prefixes: only models whose names start so are sent a temperature, as others may reject it."""

    model: str
    url: str
    api_key: str
    temperature: float = 0.0
    temperature_prefixes: tuple[str, ...] = ()
    max_tokens: int = 4096
    timeout: float = 60.0


def providers(environ) -> dict[str, dict]:
    """Providers that the environment describes: PLUMBLINE_<NAME>_URL, _MODEL and _API_KEY, and an unnamed one without <NAME>."""
    found: dict[str, dict] = {}
    for key, value in environ.items():
        m = re.fullmatch(r"PLUMBLINE(?:_([A-Z0-9]+))?_(URL|MODEL|API_KEY)", key)
        if m and value.strip():
            found.setdefault((m[1] or "").lower(), {})[m[2].lower()] = value.strip()
    return found


def default_config(environ=os.environ, provider: str | None = None, model: str | None = None, api_key: str | None = None) -> ModelConfig:
    """The settings to use. Arguments win over PLUMBLINE_PROVIDER, that over the only, or first by name, provider with a key.

    PLUMBLINE_MODEL is for the provider that the environment chooses and doesn't follow an argument to another one.
    """
    known = providers(environ)
    keyed = sorted(name for name, own in known.items() if own.get("api_key"))
    chosen = environ.get("PLUMBLINE_PROVIDER", "").strip().lower()
    chosen = chosen if chosen and chosen in known else next(iter(keyed), "")
    name = chosen if provider is None else provider.lower()
    if provider is not None and name not in known:
        raise ValueError(f"there is no provider {provider!r}; known are {', '.join(sorted(known)) or 'none'}")
    own = dict(known.get(name, {}))
    if name == chosen and environ.get("PLUMBLINE_MODEL"):
        own["model"] = environ["PLUMBLINE_MODEL"]
    own |= {k: v for k, v in (("model", model), ("api_key", api_key)) if v}
    missing = [k for k in ("model", "url", "api_key") if not own.get(k)]
    if missing:
        raise AuthError(f"not set for provider {name!r}: {', '.join(missing)}")
    return ModelConfig(own["model"], own["url"], own["api_key"])


def http_send(config: ModelConfig, body: dict) -> tuple[int, dict]:
    """(status, JSON answer) of one POST."""
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {config.api_key}"}
    try:
        with urllib.request.urlopen(urllib.request.Request(config.url, json.dumps(body).encode(), headers), timeout=config.timeout) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        try:
            return e.code, json.loads(e.read())
        except ValueError:
            return e.code, {}
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise OverloadError(f"no usable answer: {e}") from e


class HostedModel:
    """Asks for JSON in the suggestion's schema and checks what comes back."""

    def __init__(self, config: ModelConfig | None = None, send: Callable[[ModelConfig, dict], tuple[int, dict]] = http_send):
        self.config, self.send = config or default_config(), send
        # The key is part of the name's hash, so answers aren't shared between keys.
        self.name = f"{self.config.model}@{self.config.url}#{hash(self.config.api_key) & 0xFFFFFFFF:08x}"

    def body(self, system: str, user: str) -> dict:
        schema = {"name": "suggestion", "strict": True, "schema": CodeSuggestion.schema()}
        out = {"model": self.config.model, "max_tokens": self.config.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_schema", "json_schema": schema}}
        return out | ({"temperature": self.config.temperature} if self.config.model.startswith(self.config.temperature_prefixes or ("\0",)) else {})

    def suggest(self, system: str, user: str, request: dict) -> CodeSuggestion:
        status, answer = self.send(self.config, self.body(system, user))
        told = str((answer.get("error") or {}).get("message", "") if isinstance(answer.get("error"), dict) else answer.get("error") or "")[:200]
        if status in (401, 403):
            raise AuthError(told or "the key was rejected")
        error = answer.get("error")
        kind = " ".join(str(error.get(k, "")) for k in ("code", "type")) if isinstance(error, dict) else ""
        if status == 402 or status == 429 and re.search("quota|credit|billing|balance", kind):
            raise QuotaError(told or "the quota is used up")
        if status == 429:
            raise RateError(told or "too many requests")
        if status >= 500:
            raise OverloadError(told or f"the service answered {status}")
        if status != 200:
            raise SuggestionError(told or f"the service answered {status}")
        try:
            choice = answer["choices"][0]
            if choice.get("finish_reason") == "length":
                raise AnswerError("the answer was cut off")
            if choice["message"].get("refusal"):
                raise AnswerError("the model refused")
            fields = json.loads(choice["message"]["content"])
            return CodeSuggestion(**{k: fields[k] for k in CodeSuggestion.schema()["required"]})
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise AnswerError(f"the answer isn't a suggestion: {e}") from e
