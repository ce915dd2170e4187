"""What runs outside the engine, by name: readers of files and of page images, language models.

Nothing here talks to a server. A user registers functions that do; the engine calls
them in tasks, with retries, fallbacks and caches (``answers``, ``enrich``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from clauselake.operators.answers import Retry

#: What an answering model is told before each prompt.
ANSWER_SYSTEM = "ตอบคำถามเป็นภาษาไทยโดยใช้เฉพาะเอกสารอ้างอิงที่ให้มา อ้างหมายเลขเอกสารในวงเล็บเหลี่ยม เช่น [1] ท้ายข้อความที่ใช้ ถ้าเอกสารไม่มีคำตอบ ให้ตอบว่า: {refusal}"
#: What a judge is told; the answer it gives is read by ``evaluation.judgement``.
JUDGE_SYSTEM = 'Compare the given answer with the model answer and with the sources. Reply with JSON alone: {"correctness": 1 to 5, "faithfulness": 1 to 5, "reason": "one sentence"}'


@dataclass(frozen=True)
class Model:
    """A language model: called with a prompt and a system prompt. ``fallback`` takes over when it stays out of reach; ``warm_up`` loads it; ``needs`` names its settings."""

    call: Callable[[str, str], str]
    tag: str = "model"
    fallback: Callable[[str, str], str] | None = None
    warm_up: Callable[[], None] = lambda: None
    #: Settings it cannot do without, as the address and the key of a server.
    needs: tuple[str, ...] = ()

    def asked(self, prompt: str, system: str, retry: Retry) -> str:
        second = self.fallback and (lambda: self.fallback(prompt, system))
        return retry.call(lambda: self.call(prompt, system), second)


@dataclass(frozen=True)
class Reader:
    """A reader of page images: a page's key and a context size to its text and whether it was cut off."""

    read: Callable[[str, int], tuple[str, bool]]
    backend: str = "reader"
    model: str = ""
    sizes: tuple[int, ...] = (8192, 16384, 32768)
    needs: tuple[str, ...] = ()


@dataclass
class Registry:
    """Backends of one kind by name."""

    kind: str
    known: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str, backend: Any) -> Any:
        self.known[name] = backend
        return backend

    def get(self, name: str) -> Any:
        if name not in self.known:
            raise KeyError(f"no {self.kind} named {name!r}; registered: {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


MODELS, READERS, EXTRACTORS, EMBEDDERS = Registry("model"), Registry("reader"), Registry("extractor"), Registry("embedder")


def as_model(backend: Model | Callable[[str], str] | str) -> Model:
    """A model, a registered name, or a function of the prompt alone."""
    if isinstance(backend, str):
        return MODELS.get(backend)
    return backend if isinstance(backend, Model) else Model(lambda prompt, system: backend(prompt))


def required(settings: dict[str, str | None], *names: str) -> list[str]:
    """The settings that a hosted backend or store cannot do without; an error names all that are missing."""
    missing = [n for n in names if not settings.get(n)]
    if missing:
        raise RuntimeError(f"missing settings: {', '.join(missing)}")
    return [settings[n] for n in names]
