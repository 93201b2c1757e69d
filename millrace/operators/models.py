"""Prompts, settings, and an adapter that puts a text-completion endpoint behind the answer loop.

The endpoint is a function of a prompt and its settings that gives text. It is
made once per task, when a batch first needs it, and called for many
rows at a time within an Arrow batch; a call that fails, takes too long or gives
no usable reply is repeated, and in the end gives null, for which the loop has a
default. Equal prompts of a batch are asked once.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators import agent

# Sampling and lengths of replies, in tokens, and the context.
GRADER = {"temperature": 0.0, "max_tokens": 200, "context": 4096}
GENERATOR = {"temperature": 0.1, "max_tokens": 1024, "context": 4096}

#: One template per decision; names in braces are filled in, and a reply is one JSON object but for the answer.
PROMPTS = {
    "contextualize": (
        "Turn the last question of a conversation into one that can be read alone. Put in what it refers to. Keep its language. "
        "If it stands alone already, repeat it.\n\nConversation:\n{history}\n\nLast question: {query}\n\n"
        'Reply with JSON only: {{"standalone_query": "...", "reason": "..."}}'
    ),
    "rewrite": (
        "A search found little for the question below. Word it anew: other terms for the same things, abbreviations spelt out, same language.\n\n"
        'Question: {query}\nSearched so far: {current}\n\nReply with JSON only: {{"rewritten": "...", "reason": "..."}}'
    ),
    "relevant": (
        "Does the passage help with the question, be it in part or as background on the same matter? Say no only where it treats something else.\n\n"
        'Question: {query}\n\nPassage:\n{passage}\n\nReply with JSON only: {{"relevant": "yes" or "no", "reason": "..."}}'
    ),
    "generate": (
        "Answer the question from the numbered passages alone, in the language of the question. Cite each statement by its passage's number in brackets. "
        "If the passages don't hold the answer, say so.\n\nPassages:\n{passages}\n\nQuestion: {query}\n\nAnswer:"
    ),
    "grounded": (
        "Is every statement of the answer held by the passages?\n\nPassages:\n{passages}\n\nAnswer:\n{answer}\n\n"
        'Reply with JSON only: {{"grounded": "yes" or "no", "reason": "..."}}'
    ),
    "addresses": (
        'Does the answer respond to the question, be it in part?\n\nQuestion: {query}\n\nAnswer:\n{answer}\n\nReply with JSON only: {{"addresses": "yes" or "no", "reason": "..."}}'
    ),
}


def prompt(name: str, **values: Column) -> Column:
    """A template with its names filled in from columns; nulls count as empty."""
    parts: list[Column] = []
    for k, part in enumerate(re.split(r"(?<!\{)\{([a-z]+)\}(?!\})", PROMPTS[name])):
        parts.append(F.coalesce(values[part].cast("string"), F.lit("")) if k % 2 else F.lit(part.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def usable(reply: str | None, wanted: str | None) -> bool:
    """Whether a reply is a text, and where a field is wanted, an object that holds it as text."""
    if not reply or wanted is None:
        return bool(reply)
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        return isinstance(json.loads(found[0])[wanted], str) if found else False
    except (ValueError, KeyError, TypeError):
        return False


class Calls:
    """Calls of one endpoint, ``parallel`` at a time, each with its own time limit from the moment it starts.

    A call that overruns is given up and its place goes to another: its thread is
    left behind (a daemon, since a call can't be stopped from outside), so prompts
    that come later are asked whatever hung before them.
    """

    def __init__(self, call: Callable[[str, dict], str], settings: dict, wanted: str | None, attempts: int, seconds: float, parallel: int):
        self.call, self.settings, self.wanted = call, settings, wanted
        self.attempts, self.seconds, self.parallel = attempts, seconds, parallel

    def replies(self, prompts: Iterable[str]) -> dict[str, str | None]:
        """Each prompt's reply; null where no attempt gave a usable one."""
        waiting, known = deque((p, 1) for p in prompts), {}
        running: dict[int, tuple[str, int, float]] = {}  # by number: prompt, attempt, when it is given up
        ended: SimpleQueue = SimpleQueue()
        numbers = count()

        def run(number: int, text: str) -> None:
            try:
                ended.put((number, self.call(text, self.settings)))
            except Exception:  # noqa: BLE001 - whatever the endpoint raises, the call counts as failed
                ended.put((number, None))

        while waiting or running:
            while waiting and len(running) < self.parallel:
                text, attempt = waiting.popleft()
                number = next(numbers)
                running[number] = (text, attempt, time.monotonic() + self.seconds)
                threading.Thread(target=run, args=(number, text), daemon=True).start()
            over = []
            try:
                number, reply = ended.get(timeout=max(0.0, min(end for *_, end in running.values()) - time.monotonic()))
                if number in running:  # else it came after it was given up
                    over = [(number, reply)]
            except Empty:
                now = time.monotonic()
                over = [(number, None) for number, (*_, end) in running.items() if end <= now]
            for number, reply in over:
                text, attempt, _ = running.pop(number)
                if usable(reply, self.wanted):
                    known[text] = reply
                elif attempt < self.attempts:
                    waiting.append((text, attempt + 1))
                else:
                    known[text] = None
        return known


def asked(endpoint: Callable[[], Callable[[str, dict], str]], settings: dict, wanted: str | None, attempts: int, seconds: float, parallel: int) -> Callable[[Column], Column]:
    """A function from prompts to replies: up to ``attempts`` calls of ``seconds`` each, then null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        calls = None
        for prompts in batches:
            calls = calls or Calls(endpoint(), settings, wanted, attempts, seconds, parallel)
            yield prompts.map(calls.replies(prompts.dropna().unique()), na_action="ignore").astype(object)

    return run


@dataclass(frozen=True)
class EndpointModels(agent.Models):
    """agent.Models over an endpoint; endpoint() makes the function that is called as (prompt, settings)."""

    endpoint: Callable[[], Callable[[str, dict], str]] = None  # type: ignore[assignment]
    attempts: int = 2
    seconds: float = 60.0
    parallel: int = 8
    grader: dict = field(default_factory=lambda: dict(GRADER))
    generator: dict = field(default_factory=lambda: dict(GENERATOR))

    def _ask(self, name: str, field_: str | None, settings: dict, attempt: int, **values: Column) -> Column:
        # The adapter repeats a call itself, so the loop's second asking has nothing to add.
        if attempt:
            return F.lit(None).cast("string")
        return asked(self.endpoint, settings, field_, self.attempts, self.seconds, self.parallel)(prompt(name, **values))

    def contextualize(self, query, history, attempt):
        return self._ask("contextualize", "standalone_query", self.grader, attempt, query=query, history=agent.history_text(history))

    def rewrite(self, original, current, attempt):
        return self._ask("rewrite", "rewritten", self.grader, attempt, query=original, current=current)

    def relevant(self, query, content, attempt):
        return self._ask("relevant", "relevant", self.grader, attempt, query=query, passage=content)

    def generate(self, query, passages):
        return F.coalesce(self._ask("generate", None, self.generator, 0, query=query, passages=agent.format_passages(passages)), F.lit(""))

    def grounded(self, answer, passages, attempt):
        return self._ask("grounded", "grounded", self.grader, attempt, answer=answer, passages=agent.format_passages(passages))

    def addresses(self, query, answer, attempt):
        return self._ask("addresses", "addresses", self.grader, attempt, query=query, answer=answer)
