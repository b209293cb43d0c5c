"""Runtime prices on the driver: a file that is fresh for a day, else one fetch, else what there is."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from pathlib import Path
from urllib.request import urlopen

TTL = 24 * 3600
#: Where the public price list is, and the seconds to wait for it.
URL = "https://raw.githubusercontent.com/BerriAI/litellm/main/model_prices_and_context_window.json"
TIMEOUT = 10


def fetched() -> str:
    with urlopen(URL, timeout=TIMEOUT) as answer:  # noqa: S310
        return answer.read().decode()


def records(text: str) -> dict:
    """Entries with finite input and output rates; none if the text is no object."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}

    def rate(entry: dict, name: str) -> bool:
        x = entry.get(name)
        return isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")

    if not isinstance(found, dict):
        return {}
    return {k: e for k, e in found.items() if isinstance(e, dict) and rate(e, "input_cost_per_token") and rate(e, "output_cost_per_token")}


def load(path: str, fetch: Callable[[], str], force: bool = False, offline: bool = False, now: float | None = None) -> tuple[dict | None, str | None]:
    """(prices, warning). None: nothing is cached and nothing usable came, so the embedded prices hold."""
    file = Path(path)
    now = time.time() if now is None else now
    cached = records(file.read_text()) if file.exists() else {}
    if cached and (offline or not force and now - file.stat().st_mtime < TTL):
        return cached, None
    if offline:
        return None, None
    try:
        text = fetch()
    except Exception as e:  # whatever the network does, a report still comes
        return (cached or None), f"prices could not be fetched: {e}" if cached else None
    fresh = records(text)
    if not fresh:
        return (cached or None), "fetched prices were not usable" if cached else None
    file.parent.mkdir(parents=True, exist_ok=True)
    part = file.with_suffix(".part")
    part.write_text(text)
    os.replace(part, file)
    return fresh, None
