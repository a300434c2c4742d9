"""Pipelines: registered operators chained in code or declared as JSON steps; nothing runs before an action."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

from ..operators import belief, filters, preassembly, transforms
from ..schema import Corpus

REGISTRY: dict[str, Callable] = {}


def register(fn: Callable, name: str | None = None) -> Callable:
    key = name or fn.__name__
    if REGISTRY.get(key, fn) is not fn:
        raise ValueError(f"{key} is registered already")
    REGISTRY[key] = fn
    return fn


for _module in (filters, transforms, preassembly, belief):
    for _name, _fn in vars(_module).items():
        if inspect.isfunction(_fn) and not _name.startswith("_") and _fn.__module__ == _module.__name__ and "c" in inspect.signature(_fn).parameters:
            register(_fn)


class Pipeline:
    """Steps ``{"function": name, "args": [...], "kwargs": {...}}``; an argument ``{"input": name}`` stands for one of the run's inputs, ``{"function": ...}`` for the value of a registered function."""

    def __init__(self, steps: list[dict] | None = None):
        self.steps = list(steps or [])
        for s in self.steps:
            self._check(s)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        return cls(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.steps)

    def append(self, name: str, *args: Any, **kwargs: Any) -> Pipeline:
        return self.insert(len(self.steps), name, *args, **kwargs)

    def insert(self, at: int, name: str, *args: Any, **kwargs: Any) -> Pipeline:
        step = {"function": name, "args": list(args), "kwargs": kwargs}
        self._check(step)
        self.steps.insert(at, step)
        return self

    @staticmethod
    def _check(step: dict) -> None:
        fn = REGISTRY.get(step.get("function", ""))
        if fn is None:
            raise KeyError(f"unknown function {step.get('function')!r}")
        inspect.signature(fn).bind(None, *step.get("args", []), **step.get("kwargs", {}))

    def run(self, corpus: Corpus, **inputs: Any) -> Any:
        def value(x: Any) -> Any:
            if isinstance(x, dict) and "input" in x:
                return inputs[x["input"]]
            if isinstance(x, dict) and "function" in x:
                return REGISTRY[x["function"]] if x.get("no_run") else REGISTRY[x["function"]](*map(value, x.get("args", [])), **{k: value(v) for k, v in x.get("kwargs", {}).items()})
            return x

        out: Any = corpus
        for s in self.steps:
            out = REGISTRY[s["function"]](out, *map(value, s.get("args", [])), **{k: value(v) for k, v in s.get("kwargs", {}).items()})
        return out
