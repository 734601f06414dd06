"""Model endpoints as DataFrame transformations: one response row for each request row, errors included.

A call that fails for a while (too many requests, a server's error, no
connection) is made again after a growing pause, a bounded number of times.
What the last try gave is the row, with the body that came with an error.
"""

from __future__ import annotations

import base64
import json
import mimetypes
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "request_id string, status string, raw_response string, error string, truncated boolean"
TIMEOUT, MAX_TOKENS = 600, 16384
#: Answers of servers after which a call is made again, picture types that can be sent, and what errors say.
AGAIN = (408, 429, 500, 502, 503, 504, 529)
PICTURES = ("image/png", "image/jpeg", "image/gif", "image/webp")
NO_RESPONSE = "Ollama response did not include a string `response` field."
NO_TEXT = "Anthropic response did not include a text content block."
NO_MODEL = "Anthropic extractor requires --model or SHEETLAKE_MODEL."


class Answer(NamedTuple):
    """What a call gave; ``again`` says that another try may help, ``after`` how many seconds the server asks to wait."""

    status: str
    raw_response: str | None = None
    error: str | None = None
    truncated: bool = False
    again: bool = False
    after: float | None = None


Ask = Callable[[str, bytes, str], Answer]


def _post(url: str, headers: dict, body: dict, keep_body: bool) -> dict | Answer:
    """The answer's JSON, or what went wrong; ``keep_body`` puts an error's body into the row."""
    ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(ask, timeout=TIMEOUT) as answer:
            return json.loads(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        detail = e.read().decode("utf-8", errors="replace")
        wait = (e.headers.get("Retry-After") or "").strip()
        said = f"HTTP {e.code}: {detail or e.reason}" if keep_body else str(e)
        return Answer("failed", detail or None if keep_body else None, said, again=e.code in AGAIN, after=float(wait) if wait.isdigit() else None)
    except json.JSONDecodeError as e:
        return Answer("failed", error=str(e))
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        return Answer("failed", error=str(e), again=True)


def local_generate(url: str, model: str, think: bool | str | None = None) -> Ask:
    """A generate endpoint that answers {response, done_reason}."""
    def ask(prompt: str, image: bytes, name: str = "") -> Answer:
        body = {"model": model, "prompt": prompt, "images": [base64.b64encode(image).decode()], "stream": False, "format": "json"}
        got = _post(url, {}, body | ({} if think is None else {"think": think}), keep_body=False)
        if isinstance(got, Answer):
            return got
        text = got.get("response")
        if not isinstance(text, str):
            return Answer("failed", json.dumps(got, ensure_ascii=False), NO_RESPONSE)
        return Answer("completed", text, truncated=got.get("done_reason") == "length")
    return ask


def media_type(name: str) -> str:
    """The media type by a picture's name; PNG where it says nothing that can be sent."""
    guess = mimetypes.guess_type(name)[0]
    return guess if guess in PICTURES else "image/png"


def text_blocks(got: object) -> str | None:
    """The texts of an answer's text blocks, a line each; null without any."""
    blocks = got.get("content") if isinstance(got, dict) else None
    texts = [b["text"] for b in blocks if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)] if isinstance(blocks, list) else []
    return "\n".join(texts).strip() or None


def hosted_messages(url: str, model: str | None, key_variable: str) -> Ask:
    """A messages endpoint that answers {content: [{type, text}], stop_reason}; the key comes from the environment."""
    def ask(prompt: str, image: bytes, name: str = "") -> Answer:
        key = os.environ.get(key_variable, "").strip()
        if not key:
            return Answer("failed", error=f"{key_variable} is not set.")
        if not model:
            return Answer("failed", error=NO_MODEL)
        picture = {"type": "image", "source": {"type": "base64", "media_type": media_type(name), "data": base64.b64encode(image).decode()}}
        body = {"model": model, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": [picture, {"type": "text", "text": prompt}]}]}
        got = _post(url, {"x-api-key": key, "anthropic-version": "2023-06-01"}, body, keep_body=True)
        if isinstance(got, Answer):
            return got
        text = text_blocks(got)
        if text is None:
            return Answer("failed", json.dumps(got, ensure_ascii=False), NO_TEXT)
        return Answer("completed", text, truncated=isinstance(got, dict) and got.get("stop_reason") == "max_tokens")
    return ask


def tried(ask: Ask, prompt: str, image: bytes, name: str, tries: int, pause: float) -> Answer:
    """The last of up to ``tries`` answers, with pauses that double or are as long as the server asks."""
    for n in range(max(1, tries)):
        try:
            got = ask(prompt, image, name)
        except Exception as e:  # any failure is a row, never a lost task
            got = Answer("failed", error=f"{type(e).__name__}: {e}")
        if not got.again or n + 1 >= tries:
            break
        time.sleep(got.after if got.after is not None else pause * 2**n)
    return got


def respond(requests: DataFrame, ask: Ask, *, lanes: int | None = None, per_second: float | None = None, tries: int = 1, pause: float = 1.0) -> DataFrame:
    """``SCHEMA`` rows for rows of request_id, prompt, image and perhaps image_path.

    ``lanes`` tasks at most call at a time and share ``per_second`` calls a
    second evenly (``lanes`` is needed for that). Write the result before use:
    calls are not repeatable, see ``operators.ledger``.
    """
    if per_second and not lanes:
        raise ValueError("a rate needs a number of lanes")
    gap = lanes / per_second if per_second else 0.0
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    named = "image_path" in requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + gap
                got = tried(ask, r.prompt, r.image, r.image_path if named else "", tries, pause)
                rows.append((r.request_id, got.status, got.raw_response, got.error, got.truncated))
            yield pd.DataFrame(rows, columns=columns)

    asked = requests.select("request_id", "prompt", "image", *(["image_path"] if named else []))
    return (asked.repartition(lanes) if lanes else asked).mapInPandas(run, SCHEMA)
